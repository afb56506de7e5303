"""Made texts for the tests."""

from __future__ import annotations

import random

LANGUAGES = {"en": "the and of to in is that it was for with on thing tion".split(),
             "fr": "le la les des et est une que dans pour eau elle aux ère".split(),
             "de": "der die das und ist nicht mit ein von zu schön über ung keit".split()}


def sentence(r: random.Random, lang: str, n: int) -> str:
    stems = LANGUAGES[lang]
    return " ".join("".join(r.choices(stems, k=r.choice([1, 1, 2, 3]))) for _ in range(n))


def sample_documents() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, junk, edge cases."""
    r = random.Random(5)
    rows: list[tuple] = []

    def add(text, lang="en", source=None):
        rows.append((len(rows), text, lang, source if source else f"src{len(rows) % 4}", len(text or "")))

    for _ in range(50):
        lang = r.choice(list(LANGUAGES))
        add("\n".join(sentence(r, lang, r.randrange(5, 40)) for _ in range(r.randrange(2, 8))), lang)
    passage = sentence(r, "en", 60)
    for k in range(4):
        add(sentence(r, "en", 30 + k) + "\n" + passage + "\n" + sentence(r, "en", 20))
    base = sentence(r, "fr", 120)
    for _ in range(6):
        words = base.split()
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = "changed"
        add(" ".join(words), "fr")
    for k in range(12):
        add("\n".join([sentence(r, "en", 12)] * 9))
        add(" ".join(w.upper() + "!!" for w in sentence(r, "en", 80).split()))
        add(" ".join(w + "***" for w in sentence(r, "de", 70).split()), "de")
    long = sentence(r, "de", 3000)
    add(long, "de")
    for text in (None, "", " \t\n ", "one", "One  TWO", "\n\n", "中文字符测试没有空格的长句子" * 4, "a\x0bb\x0cc\rd"):
        add(text)
    add(rows[3][1], rows[3][2])
    rows.append(rows[4])  # a repeated row
    rows.append((len(rows), "no source here and no language either", None, None, 37))
    return rows
