"""Column expressions; all stay inside whole-stage code generation."""
