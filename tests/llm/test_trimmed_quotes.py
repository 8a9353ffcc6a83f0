"""Quotes of a part of a message find the message they were trimmed from."""

from sunframe.llm import quoting

POEM = "The first line is here.\nThe second line follows it.\nThe third line ends it."
LETTER = "Opening words of the letter.\n\nThe middle part, which is long.\n\nThe end of it."
ROWS = [
    (1, 0, POEM),
    (1, 1, LETTER),
    (1, 2, "> The second line follows it.\n> The third line ends it.\nTwo lines of three."),
    (1, 3, "> Opening words of the letter.\n>\n> The middle part, which is long.\nTwo paragraphs of three."),
    (1, 4, "It is late. We shall meet at noon by the old bridge. Bring the maps."),
    (1, 5, "> we shall meet at NOON by the old bridge.\nOne sentence of a line."),
    (1, 6, "> We shall meet at noon\n> by the old bridge. Bring the maps.\nTwo sentences, wrapped anew."),
    (1, 7, "> Opening words of the letter.\n> [...]\n> The end of it.\nThe middle left out."),
    (1, 8, "> nobody said this.\n> nor this.\nNo source."),
    (1, 9, "> says this first. And this.\nown says this first. And this."),
    (2, 0, "> The second line follows it.\n> The third line ends it.\nQuoted elsewhere."),
]


def test_trimmed_quotes_are_linked(spark):
    df = spark.createDataFrame([(c, t, "user", x) for c, t, x in ROWS], "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): r for r in quoting.conversations_without_quotes(df).collect()}
    assert len(got) == len(ROWS)
    parents = {k: (r.parent_conv, r.parent_turn) for k, r in got.items() if r.n_linked}
    assert parents == {(1, 2): (1, 0), (1, 3): (1, 1), (1, 5): (1, 4), (1, 6): (1, 4), (1, 7): (1, 1), (2, 0): (1, 0)}
    assert all(r.n_linked == 1 for k, r in got.items() if k in parents)
    assert (got[1, 6].root_turn, got[1, 6].depth) == (4, 1)
    assert got[1, 8].parent_turn is None
