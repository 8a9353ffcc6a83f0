import pytest

WORDS_EN = "the and that with from this have would there which about other".split()
WORDS_DE = "der und die nicht sich auch werden zwischen schon wieder durch gegen".split()


def _prose(words, n, seed):
    return " ".join(words[(seed * 7 + i * i * 3 + i) % len(words)] for i in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, repeated rows, clashing extra columns."""
    rows = []
    for i in range(60):
        en = i % 2 == 0
        rows.append((i, _prose(WORDS_EN if en else WORDS_DE, 20 + i, i), "en" if en else "de", f"s{i % 4}", 7))
    base = rows[3][1]
    rows += [(100, base, "de", "s1", 7), (101, base + " noch", "de", "s2", 7), (102, None, None, None, None),
             (103, "", "en", "s0", 0), (104, "   \t\n", None, "s0", 5), (105, "1234 5678 !!", "en", None, 3),
             (None, "the and that", "en", "s1", 3), (None, "the and that", "en", "s1", 3), (106, "x", "en", "s1", 1),
             (106, "x", "en", "s1", 1), (107, _prose(WORDS_EN, 9000, 5), "en", "s3", 9), (108, "ab" * 6000, "en", "s3", 9),
             (109, "Mail a.b@c.example.org, 10.0.0.256 and 10.0.0.255; card 4111 1111 1111 1111, +1 (238) 555-6608.", "en", "s2", 1),
             (110, "日本語 ｅ ñandú 😀 +49 30 1234567 x_y@z.de", None, "s2", 2), (111, "1 2 3 4 5 6 7 8 9 " * 3000, "en", "s0", 3),
             (112, "<|endoftext|> and   spaces", "en", "s0", 3)]
    extra = [(*r, "clash", 1.0, "clash") for r in rows]
    return spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long, "
                                        "score string, size double, component_id string").repartition(3)
