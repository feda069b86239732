"""Abuse in well-formed texts: clean and abusive documents are judged apart."""

import random
import re

import numpy as np

from lodestone.llm import quality_model, wording


def prose(draw, n, extra=(), every=12):
    words = [draw.choice("the of river stone under light walks and slow green garden over letter with house road evening to water in".split()) + ("" if draw.random() < 0.5 else draw.choice(["", "s", "ly", "ing"])) for _ in range(n)]
    for i in range(0, n, every):
        if extra:
            words[i] = draw.choice(extra)
    return " ".join(w.capitalize() + "." if i % 9 == 8 else w for i, w in enumerate(words))


ABUSE = {"en": ["moron", "scum", "worthless"], "de": ["Arschloch", "Abschaum", "VERSAGER"], "fr": ["crétin", "ABRUTI", "connard"], "es": ["imbécil", "escoria", "ESTÚPIDO"]}


def test_abuse_of_ordinary_form_is_rejected_and_clean_texts_are_kept(spark):
    draw = random.Random(3)
    rows = [(i, prose(draw, 80 + i), "clean") for i in range(80)]
    rows += [(100 + 10 * k + i, prose(draw, 80 + i, ABUSE[lang]), lang) for k, lang in enumerate(ABUSE) for i in range(4)]
    rows += [(200 + i, "@@ ## " * 60 + "x" * i, "junk") for i in range(20)]
    rows += [(300, prose(draw, 150) + " A stupid mistake.", "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {}
    for r in quality_model.score(docs, quality_model.train(docs)).collect():
        kept.setdefault(r["lang"], []).append(r["quality_score"] >= 0.5)
    share = {k: sum(v) / len(v) for k, v in kept.items()}
    assert share == {"clean": 1.0, "junk": 0.0, **dict.fromkeys(ABUSE, 0.0)}


def test_counts_by_hand():
    texts = ["You idiot. What a clown—MORON! Fine words here.", "", "«Crétin» dit-il. CRÉTIN", "nothing at all", "\n\n", "x" * 3000 + " scum", "un idiot abruti"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    got = wording.counts(wording.words(np.frombuffer(data, np.uint8), offsets), len(texts))
    listed = set(" ".join([*wording.INSULTS.values(), *wording.SLIGHTS.values()]).split())
    insults = set(" ".join(wording.INSULTS.values()).split())
    split = lambda t: re.findall(r"[^\W\d_]+", t.lower())
    for i, t in enumerate(texts):
        sentences = [s for s in map(split, re.split(r"[.!?\n]", t)) if s]
        hits = [w for w in split(t) if w in listed]
        want = (len(split(t)), len(hits), len(set(hits)), len(sentences), sum(bool(insults & set(s)) for s in sentences))
        assert tuple(int(got[k][i]) for k in ("words", "hits", "kinds", "sentences", "insulted")) == want
