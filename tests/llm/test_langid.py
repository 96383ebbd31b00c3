import random

import numpy as np

from changelens.llm import langid
from common import DOC_SCHEMA, odd_documents

LANGS = {"en": "the and that ing tion ough ght sh th ly", "de": "der und sch ung keit ö ü ß ein zu",
         "ru": "это как при ств ого ый ие на по", "fr": "les eux ment é è ç que tion ou"}


def _text(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    parts = LANGS[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


def _rows():
    return [(i, _text(lang, 60, i), lang, "s", 1) for i, lang in enumerate(list(LANGS) * 25)]


def test_held_out_accuracy_and_spans(spark):
    rows = _rows()
    model = langid.train(spark.createDataFrame(rows[:80], DOC_SCHEMA), "text", "lang", "doc_id")
    assert model.languages == sorted(LANGS)
    held = rows[80:] + [(500, _text("en", 30, 1) + " " + _text("ru", 20, 2) + " " + _text("de", 40, 3), "de", "s", 1)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(held, DOC_SCHEMA), model).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows[80:])
    spans = got[500].spans
    assert [s.lang for s in spans] == ["en", "ru", "de"]
    assert (spans[0].first, spans[-1].end) == (0, 90)
    assert abs(spans[0].end - 30) <= 1 and abs(spans[1].end - 50) <= 1


def test_scripts_narrow_candidates(spark):
    model = langid.train(spark.createDataFrame(_rows(), DOC_SCHEMA), "text", "lang", "doc_id")
    used = {lang: {langid._NAMES[s] for s in np.flatnonzero(model.scripts[:, i])}
            for i, lang in enumerate(model.languages)}
    assert used["ru"] == {"cyrillic"} and used["en"] == {"latin"}


def test_odd_rows(spark):
    df = spark.createDataFrame(odd_documents(), DOC_SCHEMA).selectExpr("*", "1 AS score", "2 AS lang_pred", "3 AS spans")
    model = langid.train(df, "text", "lang", "doc_id")
    got = langid.predict(df, model).collect()
    assert len(got) == len(odd_documents())
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id in (101, 102, 103, 104):
            assert (r.lang_pred, r.score, r.spans) == ("und", 0.0, [])
        else:
            assert r.lang_pred in model.languages and r.spans
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns
    assert not {101, 102, 103, 104} & {r.doc_id for r in kept.collect()}


def test_letters_of_the_last_planes(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma", "en", "s", 1), (2, "\U00030010\U00030011", None, "s", 1)], DOC_SCHEMA)
    model = langid.train(df, "text", "lang", "doc_id")
    assert all(r.lang_pred != "und" for r in langid.predict(df, model).collect())


def test_a_text_in_three_known_languages_stays(spark):
    own = {x: [f"{x}{y}{z}{x}" for y in "aeiou" for z in "klmnr"] for x in ("qu", "sch", "zh")}
    rows = [(i, " ".join(own[x]), x, "s", 1) for i, x in enumerate(list(own) * 3)]
    rows.append((100, " ".join(own["qu"][:10] + own["sch"][:8] + own["zh"][:8]), None, "s", 1))
    df = spark.createDataFrame(rows, DOC_SCHEMA)
    model = langid.train(df.where("lang IS NOT NULL"), "text", "lang", "doc_id")
    assert langid.keep_identified(df, model).where("doc_id = 100").count() == 1


def test_nothing_learned_and_empty_table(spark):
    df = spark.createDataFrame([(1, "hello", None, "s", 1)], DOC_SCHEMA)
    model = langid.train(df, "text", "lang", "doc_id")
    assert [(r.lang_pred, r.score) for r in langid.predict(df, model).collect()] == [("und", 0.0)]
    assert langid.keep_identified(df, model).count() == 1
    assert langid.predict(df.limit(0), model).collect() == []


def test_viterbi_against_brute_force():
    r = np.random.default_rng(1)
    bounds = np.array([0, 0, 4, 5, 11])
    scores = r.normal(size=(11, 3)).astype(np.float32) * 3
    got = langid.viterbi(scores, bounds, 2.0)
    for a, b in zip(bounds, bounds[1:]):
        paths = [[]]
        for _ in range(a, b):
            paths = [p + [s] for p in paths for s in range(3)]
        def worth(p):
            return sum(scores[a + i, s] for i, s in enumerate(p)) - 2.0 * sum(x != y for x, y in zip(p, p[1:]))
        assert abs(worth(got[a:b].tolist()) - max(map(worth, paths))) < 1e-3
