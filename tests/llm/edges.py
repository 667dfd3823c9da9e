from __future__ import annotations

#: Nulls, empty texts, ties, repeated rows, non-ASCII, one very long text.
EDGES = [
    (None, "no id here but words enough to count as a text of its own"),
    (1, None),
    (2, ""),
    (3, " \t\n"),
    (4, "one"),
    (5, "Ünïcödé wörds and 中文 text, with 12 numbers"),
    (6, "same text twice for a tie " * 3),
    (7, "same text twice for a tie " * 3),
    (8, "repeated row of text"),
    (8, "repeated row of text"),
    (9, "long words of every kind " * 20000),
]
