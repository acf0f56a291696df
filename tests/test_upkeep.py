"""What is kept up to date, against counting everything again, plain rules and labelled examples."""

import random
import re
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from quorate.operators import boundaries, mentions, prompts, recount, snapshots, state
from quorate.sources import shared


def frames(spark, texts, terms, links):
    return {
        "texts": spark.createDataFrame(texts, "doc_id long, text string"),
        "terms": spark.createDataFrame(terms, "company_id int, term string"),
        "links": spark.createDataFrame(links, "doc_id long, company_id int"),
    }


@pytest.mark.parametrize("seed", [1, 2])
def test_recount_equals_counting_all_again(spark, seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "delta", "x&y"]
    draw = lambda: None if r.random() < 0.1 else " ".join(r.choice(words) for _ in range(r.randrange(12)))
    texts = [(i, draw()) for i in range(60)] + [(3, "beta beta"), (4, "beta"), (4, "beta")]
    terms = [(c, t) for c in range(6) for t in r.sample([*words, "alpha beta", "beta gamma"], 2)]
    links = [(i, c) for i in range(70) for c in range(7) if r.random() < 0.5]
    before = frames(spark, texts, terms, links)
    new_texts = [(i, draw() if r.random() < 0.2 else t) for i, t in texts if r.random() < 0.9] + [(80, "alpha x&y"), (4, "beta")]
    new_terms = [t for t in terms if r.random() < 0.85] + [(2, "delta delta"), (6, "alpha")]
    new_links = [x for x in links if r.random() < 0.9] + [(80, 1), (80, 6), (1, 6), (90, 2)]
    after = frames(spark, new_texts, new_terms, new_links)
    by = ["doc_id", "company_id"]
    for count in (mentions.count_alternation, mentions.count_sum):
        full = lambda x: mentions.linked(count(x["texts"], x["terms"]), x["links"], by)  # noqa: E731, B023
        known = shared.saved(full(before))
        changes = shared.saved(recount.recount(before, after, known, count=count))
        want = {tuple(x) for x in full(after).collect()}
        assert {tuple(x) for x in recount.applied(known, after["links"], changes, by).collect()} == want
        was = {(x["doc_id"], x["company_id"]): x["nbocc"] for x in known.collect()}
        assert {tuple(x) for x in changes.collect()} == {(d, c, n, was.get((d, c))) for d, c, n in want if was.get((d, c)) != n}
    assert recount.recount(before, before, shared.saved(full(before)), count=count).count() == 0


def test_recount_counts_only_what_may_have_changed(spark):
    texts = [(i, "alpha beta") for i in range(50)]
    before = frames(spark, texts, [(1, "alpha"), (2, "beta")], [(i, 1 + i % 2) for i in range(50)])
    after = frames(spark, [(0, "beta"), *texts[1:]], [(1, "alpha"), (2, "beta"), (3, "beta")], [(i, 1 + i % 2) for i in range(50)] + [(9, 1)])
    seen = []

    def count(docs, terms, key, text):
        seen.append((docs.count(), terms.count()))
        return mentions.count_alternation(docs, terms, key, text)

    known = shared.saved(mentions.linked(mentions.count_alternation(before["texts"], before["terms"]), before["links"], ["doc_id", "company_id"]))
    got = {tuple(x) for x in recount.recount(before, after, known, count=count).collect()}
    assert got == {(0, 1, 0, 1), (9, 1, 1, None)}
    assert seen == [(1, 3), (49, 1), (1, 1)]  # the edited text, the new company's term, the new link


def events(rows):
    return [(i, k % 7, s, k % 3 if s == "ok" else None, f"j{k}" if s == "ok" else None, f"v{k % 2}") for i, (k, s) in enumerate(rows)]


SHAPE = "seq long, pair int, status string, note int, justification string, version string"


def test_versions_fold_to_the_state_of_all_events(spark):
    r = random.Random(4)
    rows = events([(r.randrange(50), r.choice(["ok", "failed", "submitted", "not_evaluated", "reloaded", "rescored"])) for _ in range(400)])
    at = snapshots.VersionedLog(spark, shared.scratch(spark), ["pair"], "seq")
    with pytest.raises(ValueError):
        at.state()
    assert at.compact() == 0
    want = {}
    for k in range(4):
        # Later deltas hold earlier events too: order is that of seq, not of arrival.
        want[at.append(spark.createDataFrame(rows[k::4], SHAPE))] = [x for j in range(k + 1) for x in rows[j::4]]
        if k == 1:
            want[at.compact()] = want[2]
    assert at.manifest()["snapshot"] and len(at.manifest()["deltas"]) == 2
    for version, own in want.items():
        plain = state.current(spark.createDataFrame(own, SHAPE), ["pair"], F.col("seq"))
        got = at.state(version)
        assert {tuple(x) for x in got.select(*plain.columns).collect()} == {tuple(x) for x in plain.collect()}
    # A reader that has begun keeps its version; what no kept version names goes.
    reading = at.state(2)
    last = at.compact()
    assert at.manifest()["deltas"] == [] and reading.count() == 7
    assert at.vacuum(keep=1) == []  # all files are young
    gone = at.vacuum(keep=1, older_s=-1)
    assert len(gone) == 5 and at.versions() == [last] and at.state().count() == 7


def test_commits_and_compaction_at_once_lose_nothing(spark):
    at = snapshots.VersionedLog(spark, shared.scratch(spark), ["pair"], "seq")
    rows = events([(k, "ok") for k in range(120)])
    jobs = [lambda k=k: at.append(spark.createDataFrame(rows[k::6], SHAPE)) for k in range(6)]
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda job: job(), [jobs[0], jobs[1], at.compact, jobs[2], jobs[3], at.compact, jobs[4], jobs[5]]))
    assert len({v for k, v in enumerate(made) if k not in (2, 5)}) == 6
    plain = state.current(spark.createDataFrame(rows, SHAPE), ["pair"], F.col("seq"))
    assert {tuple(x) for x in at.state().select(*plain.columns).collect()} == {tuple(x) for x in plain.collect()}


def test_prompts_by_the_text_they_had(spark):
    edits = [("v1", "a {article}", 10), ("v1", "a {article}", 20), ("v1", "b {article}", 30), ("v1", "a {article}", 40), ("v2", "z", 15), ("v2", None, 25), ("v3", "x", 5), ("v3", "y", 5)]
    registry = prompts.history(spark.createDataFrame(edits, "version string, template string, since int"))
    assert sorted((r["version"], r["template"], r["since"], r["until"]) for r in registry.collect()) == [("v1", "a {article}", 10, 30), ("v1", "a {article}", 40, None), ("v1", "b {article}", 30, 40), ("v2", "z", 15, 25), ("v3", "y", 5, None)]
    asked = [(1, "v1", 9), (2, "v1", 10), (3, "v1", 29), (4, "v1", 30), (5, "v1", 99), (6, "v2", 24), (7, "v2", 25), (8, "v9", 1), (9, None, 1), (10, "v1", None)]
    got = prompts.as_of(spark.createDataFrame(asked, "id int, version string, at int"), registry)
    assert {r["id"]: r["prompt_since"] for r in got.collect()} == {1: None, 2: 10, 3: 10, 4: 30, 5: 40, 6: 15, 7: None, 8: None, 9: None, 10: None}
    assert [tuple(r) for r in prompts.reworded(got).collect()] == [("v1", 2, 4)]


def plain_sentences(text, known):
    pieces, out, held = re.split(r"(?<=[.!?])(?=[ \t\n\x0B\f\r])", text), [], ""
    for k, p in enumerate(pieces):
        held += p
        word = re.sub(r"^[\W_]+|[^\w.]+$", "", p.split()[-1].lower()) if p.split() else ""
        kind = word.removesuffix(".")
        small = k + 1 < len(pieces) and re.match(r"\s+[a-zà-ÿ]", pieces[k + 1])
        if not (p.endswith(".") and (kind in known or re.fullmatch(r"[^\W\d_]", kind) or small)):
            out, held = [*out, held], ""
    return [s.lstrip() for s in [*out, held] if s.strip()]


def test_sentences_end_where_the_corpus_says(spark):
    """Labelled: abbreviations are learned from their periods; initials, decimals and small letters end no sentence."""
    r = random.Random(2)
    names = "Martin Durand Bernard Petit Robert Moreau".split()
    verbs = "vend achète dirige quitte rejoint".split()
    corpus = [(i, " ".join(f"{r.choice(['M.', 'Mme', 'Cie.', 'Sté.'])} {r.choice(names)} {r.choice(verbs)} la société {r.choice(names)}." for _ in range(8))) for i in range(150)]
    types = boundaries.word_types(spark.createDataFrame(corpus, "doc_id long, text string"))
    known = boundaries.abbreviations(types)
    found = {x["type"] for x in known.collect()}
    assert {"m", "cie", "sté"} <= found and not found & {"durand", "martin", "mme"}
    labelled = {
        "M. Durand vend. Il part.": ["M. Durand vend.", "Il part."],
        "La Cie. Martin gagne 3.5 points. Bien !  Oui.": ["La Cie. Martin gagne 3.5 points.", "Bien !", "Oui."],
        "J. P. Petit signe. Fin": ["J. P. Petit signe.", "Fin"],
        "Le no. 5 et approx. dix. Voilà?\nNon.": ["Le no. 5 et approx. dix.", "Voilà?", "Non."],
        "": [], "   ": [], ". ": ["."], "un": ["un"], "La Sté. Petit!": ["La Sté. Petit!"],
    }
    labelled["Le no. 5 et approx. dix. Voilà?\nNon."] = ["Le no.", "5 et approx. dix.", "Voilà?", "Non."]  # `no` is not in the corpus
    rows = list(enumerate([*labelled, None]))
    got = boundaries.sentences(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()
    for i, t in rows:
        own = sorted((x["pos"], x["n"], x["sentence"].rstrip()) for x in got if x["doc_id"] == i)
        want = labelled.get(t, [])
        assert own == [(k, len(want), s) for k, s in enumerate(want)], t
        assert [s.rstrip() for s in plain_sentences(t or "", found)] == want


def test_words_of_a_text_are_bared_as_one_by_one(spark, monkeypatch):
    r = random.Random(5)
    texts = ["".join(r.choice("aB\u00c9\u03a39.,)(\u00ab\u2028\u0085\U0001f9ea \n\t-") for _ in range(60)) for _ in range(400)] + ["", " ", None, "x" + ")" * 4_000 + "y", "." * 4_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    tokens = df.where("text IS NOT NULL").select(F.explode(F.split("text", boundaries.SPACE + "+")).alias("t")).select(boundaries._bare(F.col("t")).alias("b"))
    want = tokens.groupBy(boundaries._typed(F.col("b")).alias("type")).agg(F.count_if(F.col("b").endswith(".")).alias("dotted"), F.count_if(~F.col("b").endswith(".")).alias("plain")).where("type <> ''")
    got = boundaries.word_types(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 100
    # The words of the corpus are counted once, and written; sums and scores are of what is written.
    asked = []
    monkeypatch.setattr(boundaries, "saved", lambda x: asked.append(x) or shared.saved(x))
    plan = boundaries.abbreviations(boundaries.word_types(spark.createDataFrame([("M. a b. M. c",)], "text string")))._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1 and "Generate" not in plan


def test_no_periods_no_abbreviations(spark):
    d = spark.createDataFrame([(1, "no period here"), (2, None)], "doc_id long, text string")
    assert boundaries.abbreviations(boundaries.word_types(d)).collect() == []
    assert boundaries.abbreviations(boundaries.word_types(d.where("false"))).collect() == []
