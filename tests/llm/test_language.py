"""Language ID against a plain version with sets in place of filters."""

import random
import unicodedata
from collections import Counter

from loam.llm import language_id


def plain_grams(text):
    seq, letter = [" ", " "], False
    for c in text or "":
        now = unicodedata.category(c)[0] == "L"
        if now:
            seq.append(c.lower() if len(c.lower()) == 1 else c)
        elif letter:
            seq.append(" ")
        letter = now
    if not any(c != " " for c in seq):
        return []
    seq += [" ", " "]
    return [g for g in ("".join(seq[i : i + 4]) for i in range(len(seq) - 3)) if g != "    "]


def plain_learn(rows):
    counts = {}
    for text, lang in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    totals = {lang: max(sum(c.values()), 1) for lang, c in counts.items()}
    best = Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            if n >= 2:
                best[g] = max(best[g], n / totals[lang])
    return {lang: {g for g, n in c.items() if n >= 2 and n / totals[lang] >= 0.1 * best[g]} for lang, c in counts.items()}


def test_identify(spark):
    rng = random.Random(5)
    parts = {"en": ["th", "ing", "on", "and"], "de": ["sch", "ung", "ö", "ein"], "fr": ["eau", "é", "que", "on"], "日": ["日本", "語", "の"], "rare": ["зд", "рав", "ш"]}
    prose = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))).capitalize() + rng.choice(["", ",", ". ", "1 "]) for _ in range(n))
    rows = [(prose(lang, rng.randint(3, 40)), lang) for lang in parts for _ in range(4 if lang == "rare" else 60)] + [("words of none", None), (None, "en"), ("123 !", "de")]
    known = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string")
    asked = [prose(lang, n) for lang in parts for n in (1, 2, 8, 30)] + [prose("en", 5) + prose("de", 5), "ßİ éÉ", "123 ... !", "", None, "q" * 500, "\x00a\x00"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    kept = plain_learn(rows)
    got = {r["doc_id"]: r for r in language_id.identify(docs, language_id.learn(known)).collect()}
    for i, text in enumerate(asked):
        grams = plain_grams(text)
        scores = {lang: sum(g in own for g in grams) / len(grams) if grams else 0.0 for lang, own in kept.items()}
        if not grams:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0), text
            continue
        first, second = sorted(scores.values(), reverse=True)[:2]
        assert abs(got[i]["score"] - first) < 0.01 and abs(got[i]["margin"] - (first - second)) < 0.02, text
        if first - second > 0.02:
            assert got[i]["lang_pred"] == max(scores, key=scores.get), text
    assert sum(r["lang_pred"] == "rare" for r in got.values()) >= 3
