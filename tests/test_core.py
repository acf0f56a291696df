"""Operators where SQL over the driver's tables says too little: large counts, repeated rows, paths by size, plain Python."""

import json
import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quorate.config import EngineConfig
from quorate.operators import agreement, blocks, classify, extraction, ledger, mentions, selection, state
from quorate.plans import operations, texts
from quorate.sources import files, shared
from quorate.streaming import collector

SF = "/root/testdata/sf0.001"


def test_kappa_and_correlation_of_large_counts(spark):
    big = 3_000_000_000
    counts = spark.createDataFrame([("a", 0, 0, big), ("a", 1, 1, big), ("a", 0, 1, big // 3)], "rater string, ref int, note int, n long")
    n = 2 * big + big // 3
    chance = ((big + big // 3) * big + big * (big + big // 3)) / n**2
    accuracy = 2 * big / n
    row = agreement.accuracy_kappa(counts).first()
    assert row["n"] == n and abs(row["accuracy"] - accuracy) < 1e-12 and abs(row["kappa"] - (accuracy - chance) / (1 - chance)) < 1e-12
    x = 3_000_000_000
    df = spark.createDataFrame([(x, 0, 0), (2 * x, 0, 1), (3 * x, 1, 1), (5 * x, 2, 0)], "x long, base int, r int")
    import statistics

    right = [1, 0, 1, 0]
    assert abs(agreement.correctness_correlation(df, "x", "base", ["r"]).first()["correlation"] - statistics.correlation([1, 2, 3, 5], right)) < 1e-8


@pytest.mark.parametrize("values", [[3, 1, 2, 2, 9, 4, 4, 4, 10, 7], [5] * 9, [1.5, None, 2.25], [1]])
def test_quantile_edges(spark, values):
    import numpy as np

    got = agreement.quantile_edges(spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double"), "x", 4).first()["_edges"]
    assert np.allclose(got, np.unique(np.quantile([v for v in values if v is not None], [0, 0.25, 0.5, 0.75, 1])))


def test_positions_of_many_small_keys(spark):
    df = spark.range(5000).select((F.col("id") % 977).alias("k"), F.col("id").alias("n"))
    rows = sorted((r["k"], -r["n"], r["position"]) for r in selection.positions(df, "k", "n", width=100).collect())
    assert [p for *_, p in rows] == list(range(5000))


def plain_mentions(rows, terms, fold, joined):
    out = {}
    for i, t in rows:
        for c in {c for c, _ in terms}:
            own = {x.lower() if fold else x for k, x in terms if k == c}
            own = sorted(own, key=lambda x: (-len(x), x))
            pattern = lambda x: r"\b" + re.escape(x) + r"\b"
            n = len(re.findall("|".join(map(pattern, own)), t or "", re.I)) if joined else sum(len(re.findall(pattern(x), t or "", re.I)) for x in own)
            if n:
                out[i, c] = out.get((i, c), 0) + n
    return out


@pytest.mark.parametrize("limit", [20_000, 0])
def test_mentions_on_both_paths_with_repeated_ids(spark, monkeypatch, limit):
    monkeypatch.setattr(mentions, "BROADCAST_TERMS", limit)
    terms = [(1, "Alpha"), (1, "alpha beta"), (1, "ALPHA"), (2, "A.B."), (2, "x.y"), (3, "R&D"), (3, "r"), (4, "Été"), (4, "a\\Eb"), (5, "gamma"), (5, "(g)")]
    texts = ["alpha beta alpha ALPHA, Beta", "A.B.C a.b. A.B.", "r&d R r&D", "été ÉTÉ l'été a\\Eb", None, "", "gamma (g) x.y.z (gamma)", "alphabet, éalpha"]
    rows = [(i // 2, t) for i, t in enumerate(texts * 2)] + [(1, "alpha beta")] * 3 + [(1, "r")] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string")
    t = spark.createDataFrame(terms, "company_id int, term string")
    got = lambda f, t: {(r["doc_id"], r["company_id"]): r["nbocc"] for r in f(d, t).collect()}
    assert got(mentions.count_sum, t) == plain_mentions(rows, terms, False, False)
    assert got(mentions.count_alternation, t.select("company_id", F.lower("term").alias("term")).distinct()) == plain_mentions(rows, terms, True, True)


@pytest.mark.parametrize("limit", [20_000, 0])
def test_phrases_by_position(spark, monkeypatch, limit):
    monkeypatch.setattr(mentions, "BROADCAST_TERMS", limit)
    r = __import__("random").Random(limit)
    bits = ["a", "B", "é", "1", "x_y", " ", "  ", ".", "-", "(", ")", "&", "\n", "\\E", "$"]
    draw = lambda n: "".join(r.choice(bits) for _ in range(n))
    terms = {(k % 6, draw(r.randrange(1, 14))) for k in range(60)} | {(7, "a b a"), (7, "a b"), (8, "a " * 11 + "b"), (8, "b a"), (9, "&"), (9, ". a . b . a . b . a . b ."), (9, "a&")}
    terms = sorted(t for t in terms if t[1])
    texts = [draw(r.randrange(60)) for _ in range(80)] + ["a b a b a b a", "A " * 40 + "b", "a & b&a & & b", " . a . b . a . b . a . b . a . b . a . b . a", None, "", "a", "&"]
    texts += [t[1] + " " + t[1] + draw(3) for t in terms]
    rows = [(i // 2, t) for i, t in enumerate(texts)]
    d, t = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(terms, "company_id int, term string")
    got = lambda f, t: {(r["doc_id"], r["company_id"]): r["nbocc"] for r in f(d, t).collect()}
    assert got(mentions.count_sum, t) == plain_mentions(rows, terms, False, False)
    assert got(mentions.count_alternation, t.select("company_id", F.lower("term").alias("term")).distinct()) == plain_mentions(rows, terms, True, True)


def test_many_terms_with_one_first_word_cost_little(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    words = [r["w"] for r in d.select(F.explode(F.split(F.lower("text"), r"(?U)\W+")).alias("w")).where("length(w) > 1").groupBy("w").count().orderBy(F.desc("count"), "w").limit(2000).select("w").collect()]
    terms = spark.createDataFrame([(k % 50, f"the {w}") for k, w in enumerate(words)], "company_id int, term string")
    began = time.time()
    n = mentions.count_sum(d, terms).agg(F.sum("nbocc")).first()[0]
    assert n > 10_000 and time.time() - began < 60


def split(t):
    return re.split(r"(?<=[.!?])\s+", t)


def plain_context(t, name):
    s = split(t)
    hit = [name.lower() in x.lower() for x in s]
    kept = [x for i, x in enumerate(s) if any(hit[max(0, i - 1) : i + 2])]
    return " ".join(kept if any(hit) else s[:3])


def test_context_is_right_and_linear(spark):
    texts = ["", "one.", "que. a. b. c. que que. d. e.", "a. b. c. d.", "Que", "a! b? QUE! c. d.", "a. que", "a.  b.\nque. c"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(extraction.context(F.col("t"), F.lit("que"))).collect()]
    assert got == [plain_context(t, "que") for t in texts]
    took = []
    for n in (2_000, 16_000):
        d = spark.range(1).select(F.repeat(F.lit("some words of it. que. "), n).alias("t"))
        d.select(F.length(extraction.context(F.col("t"), F.lit("que")))).collect()
        began = time.time()
        assert d.select(F.length(extraction.context(F.col("t"), F.lit("que")))).first()[0] > 16 * n
        took.append(time.time() - began)
    assert took[1] < 5


def plain_scores(t):
    said = [re.findall(r"\w\w+", s.lower()) for s in split(t)]
    df = Counter(w for s in said for w in set(s))
    out = []
    for s in said:
        w = [n * (math.log((1 + len(said)) / (1 + df[x])) + 1) for x, n in Counter(s).items()]
        out.append(sum(w) / math.sqrt(sum(x * x for x in w)) if w else 0.0)
    return out


def test_scores_are_made_where_a_text_lies(spark):
    rows = [(1, None), (2, ""), (3, "a. b! c?"), (4, "One two two. Two que three!  \n \u00c9t\u00e9 que. x y. One two two."), (4, "same id. other text."), (None, "no id. at all."), (5, "w1 w2. w2 w3. " * 700), (6, " ")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(2)
    found = extraction.sentence_scores(df, "id", name=F.lit("QUE"))
    got = sorted((repr(r["id"]), r["pos"], r["n"], r["named"], round(r["score"], 9)) for r in found.collect())
    want = [(repr(i), k, len(split(t)), "que" in split(t)[k].lower(), round(s, 9)) for i, t in rows if t is not None for k, s in enumerate(plain_scores(t))]
    assert got == sorted(want) and found.columns == ["id", "pos", "n", "named", "score"]
    assert extraction.sentence_scores(df.where("false"), "id").count() == 0
    # No words are sorted or shuffled, so what a task holds does not grow with its partition.
    docs = shared.table(spark, SF, "documents")
    for made in (extraction.sentence_scores(docs), extraction.summary(docs, F.lit("que"))):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("Exchange", "Sort", "Aggregate", "Window") if x in plan], plan


def test_windows_of_a_text_take_linear_time(spark):
    took = []
    for n in (1_000, 250_000):
        df = spark.range(1).select("id", F.repeat(F.lit("some words "), n).alias("text"))
        began = time.time()
        assert classify.sentiment(df, "id", "text", "length").count() == 1 and classify.second_note(df, "id", "text", "length").count() == 1
        took.append(time.time() - began)
    assert took[1] < 12, took


def test_classifier_notes(spark):
    def label(t):
        return (0, 1, 2, 1)[len(t) % 4], (1 + len(t) % 7) / 8

    def sentiment(t):
        w = t.split()
        if not w:
            return 1
        got = [label(" ".join(w[a : a + 500])) for a in range(0, len(w), 500)]
        return round(sum(n * c for n, c in got) / sum(c for _, c in got))

    pairs = {r["pair_id"]: r for r in operations.classifier_pairs(spark, SF).collect()}
    short = {r["pair_id"]: r["summary"] for r in extraction.summary(spark.createDataFrame([(i, ((r["title"] or "") + " " + (r["content"] or "")).strip(" ")) for i, r in pairs.items()], "pair_id long, text string"), F.lit("que"), key="pair_id").collect()}
    got = {r["pair_id"]: r for r in classify.classified(operations.classifier_pairs(spark, SF), "length").collect()}
    assert got.keys() == pairs.keys()
    kinds = set()
    for i, r in pairs.items():
        text = ((r["title"] or "") + " " + (r["content"] or "")).strip(" ")
        dedicated = "que" in (r["title"] or "").lower()
        kind = "general" if not dedicated else "dedicated" if r["content"].lower().count("que") > 1 else "dedicated_single"
        kinds.add(kind)
        target = 9 if kind == "dedicated" else sentiment(plain_context(text, "que"))
        g = got[i]
        assert (g["kind"], g["note_full"], g["note_targeted"], g["note_tfidf"], g["resume"]) == (kind, sentiment(text), target, sentiment(short[i]), short[i])
    assert len(kinds) == 3


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


def plain_runs(t, text, size, stride):
    """(start, ids, text) of the runs of a text's tokens."""
    ids = t.encode(text, add_special_tokens=False).ids
    if len(ids) <= size:
        return [(0, ids, text)]
    return [(a, ids[a : a + size], t.decode(ids[a : a + size])) for a in range(0, len(ids), stride)]


def test_token_blocks(spark, tokenizer):
    import hashlib

    got = sorted(tuple(r) for r in texts.token_blocks(spark, SF).collect())
    want = []
    for r in shared.table(spark, SF, "documents").collect():
        for kind, size, stride in (("block", 500, 500), ("overlap", 512, 462)):
            if r["text"] and r["text"].strip():
                want += [(r["doc_id"], kind, a, len(ids), hashlib.md5(t.encode()).hexdigest()) for a, ids, t in plain_runs(tokenizer[1], r["text"], size, stride)]
    assert got == sorted(want) and any(r[2] for r in got)


def test_token_runs_of_awkward_texts(spark, tokenizer, monkeypatch):
    path, t = tokenizer
    monkeypatch.setattr(blocks, "HELD", 40)
    rows = [(1, None), (2, ""), (3, " \n\u00a0"), (4, "one"), (4, "two"), (None, "no id"), (5, "\U0001f9ea" * 30), (6, "word " * 200), (7, "x" * 200_000), (8, "a <|endoftext|> b " * 9)]
    cuts = {"block": blocks.Cut(10, 10, False), "overlap": blocks.Cut(12, 7, True)}
    got = blocks.token_runs(spark.createDataFrame([(i, x, "k") for i, x in rows], "id long, text string, kind string"), "id", "text", path, cuts)
    want = [(i, kind, a, ids, said) for i, x in rows[3:] for kind, c in cuts.items() for a, ids, said in plain_runs(t, x, c.size, c.stride)]
    order = lambda found: sorted(map(repr, found))
    assert order(tuple(r) for r in got.collect()) == order(want)
    none = blocks.token_runs(spark.createDataFrame([], "id long, text string"), "id", "text", path)
    assert none.count() == 0 and none.columns == ["id", "kind", "start", "ids", "text"]


def test_token_runs_encode_a_text_once(spark, tokenizer, tmp_path, monkeypatch):
    import tokenizers

    path, t = tokenizer
    # Latin texts are done by the quick encoder, which says the same, characters that a cut parts included.
    rows = [(1, "\u00e9t\u00e9 \u017b\u00f3\u0142w 50 \u00bfqu\u00e9? don't  \n\n x" * 20), (2, "\U0001f9ea\u4e2d" * 30), (3, "a <|endoftext|> b " * 9)]
    cuts = {"block": blocks.Cut(7, 7, False), "overlap": blocks.Cut(9, 5, True)}
    got = blocks.token_runs(spark.createDataFrame(rows, "id long, text string"), "id", "text", path, cuts)
    want = [(i, kind, a, ids, said) for i, x in rows for kind, c in cuts.items() for a, ids, said in plain_runs(t, x, c.size, c.stride)]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    # A file that puts tokens around a text.
    around = tokenizers.Tokenizer.from_file(path)
    around.post_processor = tokenizers.processors.TemplateProcessing(single="<s> $A </s>", special_tokens=[("<s>", 0), ("</s>", 2)])
    around.save(str(tmp_path / "around.json"))
    around = tokenizers.Tokenizer.from_file(str(tmp_path / "around.json"))
    got = blocks.token_runs(spark.createDataFrame(rows, "id long, text string"), "id", "text", str(tmp_path / "around.json"), cuts)
    for r in got.collect():
        ids = around.encode(dict(rows)[r["id"]], add_special_tokens=r["kind"] == "overlap").ids
        c = cuts[r["kind"]]
        assert r["ids"] == ids[r["start"] : r["start"] + c.size] and r["text"] == around.decode(r["ids"], skip_special_tokens=True)
        assert r["kind"] == "block" or r["start"] or r["ids"][0] == 0


def test_notes_by_tokens(spark, tokenizer):
    path, t = tokenizer
    rows = [(1, "ab " * 1300), (2, "short"), (3, None), (4, " "), (5, "\u00e9t\u00e9, l'action monte. " * 400)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: (r["note"], r["confidence"]) for r in classify.sentiment(df, "id", "text", "length", tokenizer=path).collect()}
    second = {r["id"]: r["note"] for r in classify.second_note(df, "id", "text", "length", path).collect()}
    assert got[3] == got[4] == (1, 1.0) and second.keys() == {1, 2, 5}
    for i in (1, 2, 5):
        text = rows[i - 1][1]
        said = [((0, 1, 2, 1)[len(x) % 4], (1 + len(x) % 7) / 8) for _, _, x in plain_runs(t, text, 500, 500)]
        assert got[i] == (round(sum(n * c for n, c in said) / sum(c for _, c in said)), pytest.approx(sum(c for _, c in said) / len(said)))
        probs = classify.LengthProbabilities().probabilities([x for _, _, x in plain_runs(t, text, 512, 462)])
        mean = [round(sum(max(p) * p[k] for p in probs) / sum(map(max, probs)), 6) for k in range(3)]
        assert second[i] == mean.index(max(mean))


def test_comparison_file(spark):
    def second(t):
        w = t.split()
        starts = [0] if len(w) <= 512 else range(0, len(w), 462)
        probs = [classify.LengthProbabilities().probabilities([" ".join(w[a : a + 512])])[0] for a in starts]
        mean = [round(sum(max(p) * p[k] for p in probs) / sum(map(max, probs)), 6) for k in range(3)]
        return mean.index(max(mean))

    pairs = {r["pair_id"]: r for r in operations.classifier_pairs(spark, SF).collect()}
    notes = {r["pair_id"]: r for r in classify.classified(operations.classifier_pairs(spark, SF), "length").collect()}
    got = {r["article_id"]: r for r in operations.comparison_file(spark, SF).collect()}
    assert got.keys() == pairs.keys()
    kinds = {"dedicated": "dedie", "dedicated_single": "dedie_unique", "general": "generaliste"}
    for i, r in pairs.items():
        text, n, g = ((r["title"] or "") + " " + (r["content"] or "")).strip(" "), notes[i], got[i]
        alone, target, whole = (second(text), None, None) if n["kind"] == "dedicated" else (None, second(plain_context(text, "que")), second(text))
        assert (g["type"], g["titre"] or "", g["company_name"], g["company_id"]) == (kinds[n["kind"]], r["title"] or "", "que", i % 3)
        assert (g["note_tfidf"], g["note_targeted"], g["note_full"]) == (n["note_tfidf"], n["note_targeted"], n["note_full"])
        assert (g["note_gpu"], g["note_targeted_gpu"], g["note_full_gpu"]) == (alone, target, whole)
        assert g["divergence_full"] == (None if alone is None else abs(n["note_full"] - alone))
        assert (g["resume"], g["texte_brut"]) == (n["resume"][:300].replace("\n", " "), text[:500].replace("\n", " "))


def test_collecting_keeps_order_and_overwrites_nothing(spark):
    at = shared.scratch(spark)
    answer = lambda n: json.dumps({"note_llm": n, "justification": "x"})
    line = lambda i, n: (json.dumps({"custom_id": f"a{i}-c1", "result": {"type": "succeeded", "message": {"content": [{"type": "text", "text": answer(n)}]}}}),)
    put = lambda rows: spark.createDataFrame(rows, "value string").coalesce(1).write.mode("append").text(f"{at}/in")
    put([line(1, 2), line(1, 0), line(2, 1)])
    collector.collect(spark, f"{at}/in", f"{at}/log", f"{at}/c1", "v4")
    put([line(2, 0)])
    collector.collect(spark, f"{at}/in", f"{at}/log", f"{at}/c1", "v4")
    one = spark.read.parquet(f"{at}/log")
    assert one.count() == 4 and one.select(*collector.ARRIVAL).distinct().count() == 4
    last = {r["custom_id"]: r["note"] for r in state.current(one.withColumnRenamed("raw", "extraction"), ["custom_id"], F.struct(*collector.ARRIVAL)).collect()}
    assert last == {"a1-c1": 0, "a2-c1": 0}
    collector.collect(spark, f"{at}/in", f"{at}/log", f"{at}/c2", "v4")
    assert spark.read.parquet(f"{at}/log").count() == 8


def test_no_folder_of_its_own_on_a_cluster(spark):
    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Away:
        conf = Conf

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared.shared_dir(Away)
    path = shared.scratch(spark)
    spark.range(3).write.parquet(path)
    fs, p = shared.file_system(spark, path)
    assert fs.exists(p)


def test_aliases_of_odd_documents(spark):
    at = shared.scratch(spark)
    for k, t in enumerate(['{"A b": ["x", "Y"], "c": "no list", "d": null, "e": []}', "[1, 2]", "not json", ""]):
        spark.createDataFrame([(t,)], "value string").coalesce(1).write.text(f"{at}/{k}")
    rows = [sorted((r["name"], r["alias"]) for r in files.read_aliases(spark, f"{at}/{k}").collect()) for k in range(4)]
    assert rows == [[("A b", "Y"), ("A b", "x")], [], [], []]
    assert files.read_aliases(spark, f"{at}/none").collect() == []


@pytest.mark.parametrize("block", ["300", "4m"])
def test_result_files_in_blocks(spark, block):
    """Records cut at true ends whatever the blocks, in files whose names and folder have spaces, percent signs and marks."""
    import csv
    import random
    import tempfile

    r, want = random.Random(1), []
    at = tempfile.mkdtemp(prefix="a b% [c] ")
    for name in ("resultats_haiku_a b.csv", "resultats_haiku_50%.csv", "resultats_queen_é[x]{1}*.csv", "resultats_llm_short.csv"):
        with open(f"{at}/{name}", "w", newline="") as f:
            w = csv.writer(f, lineterminator="\r\n" if "50" in name else "\n")
            w.writerow(files.RESULT_COLUMNS if "short" not in name else ["article_id", "note, llm", "note_llm"])
            for k in range(60):
                text = "".join(r.choice(['"', "\n", "a", ",", "\n\n", " ", "é"]) for _ in range(r.randrange(200 if k != 7 else 2000)))
                row = [str(k), "c", "v", "ok", str(k % 3), text, "", "x", f"end{k}"]
                if k % 9 == 0 and "é" in name:
                    f.write("\n")
                w.writerow(row)
                want.append((name, [v or None for v in row]))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)
    try:
        paths = files.resolved(spark, [at.replace("[", "\\[").replace("]", "\\]") + "/*.csv"])
        seen = {x["file"]: (x["rater"], x["usable"]) for x in files.result_files(spark, paths).collect()}
        got = sorted((x["file"], x["row_ord"], [x[c] for c in files.RESULT_COLUMNS]) for x in files.read_results(spark, paths).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen == {"resultats_haiku_a b.csv": ("haiku", True), "resultats_haiku_50%.csv": ("haiku", True), "resultats_queen_é[x]{1}*.csv": ("queen", True), "resultats_llm_short.csv": ("lama", False)}
    assert [(f, v) for f, _, v in got] == sorted((w for w in want if "short" not in w[0]), key=lambda w: w[0])


def test_result_file_of_parts_and_headers_read_alone(spark, monkeypatch):
    at = f"{shared.scratch(spark)} p 5%"
    row = lambda i: [(F.concat(F.lit('say "'), i, F.lit('",\nx')) if c == "justification" else i).alias(c) for c in files.RESULT_COLUMNS]
    rows = spark.range(0, 400, 1, 5).select(*row(F.col("id").cast("string")))
    files.write_results(rows, f"{at}/resultats_haiku_V4 a.csv")
    files.write_results(rows.limit(0), f"{at}/resultats_llm_none.csv")
    paths = files.resolved(spark, [f"{at}/*.csv"])
    assert [len(files.parts_of(spark, p)) for p in paths] == [5, 1]
    read = []
    monkeypatch.setattr(files, "_lines", lambda *a, real=files._lines: read.append(a) or real(*a))
    assert [(x["file"], x["rater"], x["usable"]) for x in files.result_files(spark, paths).collect()] == [("resultats_haiku_V4 a.csv", "haiku", True), ("resultats_llm_none.csv", "lama", True)]
    assert not read  # of a file's lines only the first is read for its header
    got = files.read_results(spark, paths).orderBy("file_ord", "row_ord").select("file", "rater", "article_id", "justification").collect()
    assert [tuple(x) for x in got] == [("resultats_haiku_V4 a.csv", "haiku", str(i), f'say "{i}",\nx') for i in range(400)]
    empty = f"{at}/resultats_llm_empty.csv"
    fs, p = shared.file_system(spark, empty)
    fs.create(p).close()
    assert shared.first_line(spark, empty) is None


def test_result_files_are_written_by_many_tasks(spark, tmp_path):
    for name in ("orders", "supplier"):
        shared.table(spark, SF, name).repartition(6 if name == "orders" else 1).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "8k")
    try:
        at = operations.written_results(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    paths = files.resolved(spark, [f"{at}/*.csv"])
    assert [p.rsplit("/", 1)[-1] for p in paths] == [f[0] for f in operations.FILES]
    assert all(len(files.parts_of(spark, p)) > 1 for p in paths)


def test_large_result_file_is_read_by_many_tasks(spark):
    import duckdb

    at = shared.scratch(spark)
    rows = spark.range(60_000).select(*[(F.concat(F.lit('say "'), F.col("id").cast("string"), F.lit('",\n'), F.repeat(F.lit("text \n"), (F.col("id") % 60).cast("int"))) if c == "justification" else F.col("id").cast("string")).alias(c) for c in files.RESULT_COLUMNS])
    files.write_results(rows.coalesce(1), f"{at}/r")
    fs, part = shared.file_system(spark, f"{at}/r/part-*.csv")
    path = f"{at}/resultats_haiku_V4_big.csv"
    fs.rename(fs.globStatus(part)[0].getPath(), shared.file_system(spark, path)[1])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        size = fs.getFileStatus(shared.file_system(spark, path)[1]).getLen()
        assert files._lines(spark, [path]).rdd.getNumPartitions() >= size >> 20 > 10
        got = files.read_results(spark, [path]).agg(F.count("*"), F.sum(F.crc32("justification")), F.sum(F.col("article_id").cast("long"))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    local = path.removeprefix("file://")
    theirs = duckdb.connect().execute(f"SELECT count(*), sum(article_id::BIGINT), list(justification) FROM read_csv('{local}', all_varchar=true, header=true, quote='\"', escape='\"', max_line_size=10000000)").fetchone()
    import zlib

    assert (got[0], got[2]) == theirs[:2] and got[1] == sum(zlib.crc32(x.encode()) for x in theirs[2])


def test_settings():
    c = EngineConfig().overlaid({"PROMPT_VERSION": "v7", "REPRENDRE": "0", "BATCH_TAILLE_MAX": "50", "SEUIL_VARIATION_PCT": "7.5", "LIMITE_PAR_ENTREPRISE": "", "MODE": "batch"})
    assert c == EngineConfig(version="v7", resume=False, batch_size=50, threshold=7.5, mode="batch")


class Crash(Exception):
    pass


def asked_rows(spark, n, size=10):
    d = spark.range(n).select(F.col("id").alias("article_id"), F.lit(7).cast("long").alias("company_id"), F.lit("c").alias("company"), F.lit("t").alias("text"), F.floor(F.col("id") / size).cast("long").alias("chunk"))
    return d.withColumn("custom_id", F.concat(F.lit("a"), F.col("article_id").cast("string"), F.lit("-c7")))


def test_submission_evaluates_its_requests_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = asked_rows(spark, 200)
    at, rater = ledger.Ledger(spark, shared.scratch(spark)), operations.ScriptedRater()
    assert at.submit(rows.mapInArrow(count, rows.schema), "scripted", rater, "v1") == 20
    assert seen.value == 200
    assert sorted(i for _, own in rater.calls.values() for i in own) == sorted(r["custom_id"] for r in rows.collect())


@pytest.mark.parametrize("before", [True, False])
def test_a_crash_around_a_call_loses_and_doubles_nothing(spark, before):
    class Crashing(operations.ScriptedRater):
        tripped = False

        def submit(self, requests, version, key):
            if before and len(self.calls) == 3 and not self.tripped:
                self.tripped = True
                raise Crash
            batch = super().submit(requests, version, key)
            if not before and len(self.calls) == 4 and not self.tripped:
                self.tripped = True
                raise Crash
            return batch

    path, rater, rows = shared.scratch(spark), Crashing(), asked_rows(spark, 100)
    with pytest.raises(Crash):
        ledger.Ledger(spark, path).submit(rows, "scripted", rater, "v1")
    again = ledger.Ledger(spark, path)
    assert again.waiting().count() == 3 and again.not_submitted().count() == 70
    again.resume(rater)
    assert again.resume(rater) == 0
    assert sorted(i for _, own in rater.calls.values() for i in own) == sorted(r["custom_id"] for r in rows.collect())
    assert again.waiting().count() == 10 and again.not_submitted().count() == 0
    assert again.requests().groupBy("custom_id").count().where("count > 1").count() == 0


def jobs_of(spark, work):
    """(what work gives, number of Spark jobs it took)."""
    group = f"jobs-{time.time()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_submission_and_cancelling_take_no_job_for_each_chunk(spark, monkeypatch):
    path, rater, rows = shared.scratch(spark), operations.ScriptedRater(), asked_rows(spark, 600)
    at = ledger.Ledger(spark, path)
    went, jobs = jobs_of(spark, lambda: at.submit(rows, "scripted", rater, "v1"))
    assert went == 60 and jobs < 20
    done, jobs = jobs_of(spark, lambda: at.cancel(rater))
    assert len(done) == 59 and "b5" not in done and jobs < 20
    assert at.cancel(rater) == []
    report = {r["batch_id"]: (r["state"], r["requests"]) for r in at.report().collect()}
    assert report.pop("b5") == ("submitted", 10) and set(report.values()) == {("cancelled", 0)}
    assert at.not_submitted().count() == 590
    monkeypatch.setattr(ledger, "CALL_BYTES", 2000)  # requests of about two chunks at a time
    small = operations.ScriptedRater()
    assert ledger.Ledger(spark, shared.scratch(spark)).submit(rows, "scripted", small, "v1") == 60
    assert list(small.asked.items()) == list(rater.asked.items())


def test_ledger_with_a_folder_for_each_chunk_is_read_on(spark):
    at, rater = ledger.Ledger(spark, shared.scratch(spark)), operations.ScriptedRater()
    asked_rows(spark, 50).write.partitionBy("chunk").parquet(f"{at.path}/requests/run=old")
    shared.create_once(spark, f"{at.path}/runs/old", '{"rater": "scripted", "version": "v0"}')
    assert at.advance("old-1", None, ledger.SUBMITTED, batch_id="b9", rater="scripted", version="v0")
    assert at.resume(rater) == 4 and at.submit(asked_rows(spark, 20), "scripted", rater, "v1") == 2
    assert sorted(i for own in rater.asked.values() for i in own) == sorted(r["custom_id"] for n in (50, 20) for r in asked_rows(spark, n).collect() if n == 20 or r["chunk"] != 1)
    assert at.requests().groupBy("batch_id").count().where("count = 10").count() == 7 and at.not_submitted().count() == 0


def test_one_of_many_writers_makes_a_change(spark):
    from concurrent.futures import ThreadPoolExecutor

    at = ledger.Ledger(spark, shared.scratch(spark))
    assert at.advance("r-0", None, ledger.SUBMITTED, batch_id="b1", rater="x", version="v1")
    seen = at.state("r-0")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: at.advance("r-0", seen, [ledger.COLLECTED, ledger.CANCELLED][k % 2], attempt=str(k)), range(16)))
    assert sum(won) == 1 and at.state("r-0")["attempt"] == str(won.index(True))
    assert at.batches().count() == 1
    with pytest.raises(ValueError):
        at.advance("r-0", at.state("r-0"), ledger.SUBMITTED)


def test_two_collectors_write_a_batch_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    path, rater, log = shared.scratch(spark), operations.ScriptedRater(), shared.scratch(spark)
    one, two = ledger.Ledger(spark, path), ledger.Ledger(spark, path)
    one.submit(asked_rows(spark, 50), "scripted", rater, "v1")
    with ThreadPoolExecutor(2) as pool:
        ended = list(pool.map(lambda x: x.collect(rater, log), (one, two)))
    assert sum(ended) == 3
    rows = spark.read.parquet(log)
    assert rows.count() == 30 and rows.select("custom_id").distinct().count() == 30


@pytest.mark.parametrize("many", [True, False])
def test_collecting_takes_no_job_for_each_batch(spark, monkeypatch, many):
    class Single(operations.ScriptedRater):
        def __getattribute__(self, name):
            if name == "results_of":
                raise AttributeError(name)
            return super().__getattribute__(name)

    rater, log = (operations.ScriptedRater if many else Single)(), shared.scratch(spark)
    at = ledger.Ledger(spark, shared.scratch(spark))
    at.submit(asked_rows(spark, 600), "scripted", rater, "v1")
    monkeypatch.setattr(ledger, "TOGETHER", 40)
    ended, jobs = jobs_of(spark, lambda: at.collect(rater, log))
    assert ended == 58 and jobs < 40
    assert at.collect(rater, log) == 0
    got = {(r["batch_id"], r["article_id"]): (r["status"], r["note"], r["version"]) for r in spark.read.parquet(log).collect()}
    ok = lambda b, a: b != 2 and a % 5 < 3
    assert got == {(f"b{b}", a): ("ok" if ok(b, a) else "failed", a % 5 if ok(b, a) else None, "v1") for a in range(600) for b in [a // 10 + 1] if b not in (3, 4)}
    assert spark.read.parquet(log).count() == 580


def test_what_a_crashed_collector_noted_is_moved_by_the_next(spark, monkeypatch):
    rater, log, path = operations.ScriptedRater(), shared.scratch(spark), shared.scratch(spark)
    at = ledger.Ledger(spark, path)
    at.submit(asked_rows(spark, 60), "scripted", rater, "v1")
    noted, made = ledger.Ledger._advanced, []

    def crashing(self, key, seen, state, **facts):
        if len(made) == 2:
            raise Crash
        made.append(key)
        return noted(self, key, seen, state, **facts)

    with monkeypatch.context() as m:
        m.setattr(ledger.Ledger, "_advanced", crashing)
        with pytest.raises(Crash):
            at.collect(rater, log)
    assert ledger.Ledger(spark, path).collect(rater, log) == 2  # of b1, b2, b5, b6 two were noted; b3 and b4 wait
    rows = spark.read.parquet(log)
    assert rows.count() == 40 and rows.select("custom_id").distinct().count() == 40


def test_deadline_fails_a_batch_and_a_late_result_is_ignored(spark):
    path, rater, log = shared.scratch(spark), operations.ScriptedRater(), shared.scratch(spark)
    at = ledger.Ledger(spark, path)
    at.submit(asked_rows(spark, 40), "scripted", rater, "v1")
    assert at.collect(rater, log, timeout_s=3600) == 2  # b1, b2; b3 is in progress, b4 has no results yet
    time.sleep(1.1)
    assert ledger.Ledger(spark, path).collect(rater, log, timeout_s=1) == 1  # b3, by when it was submitted
    rater.status = lambda batch: "ended"
    assert at.collect(rater, log, timeout_s=1) == 0
    rows = spark.read.parquet(log).where("batch_id = 'b3'").collect()
    assert len(rows) == 10 and {r["status"] for r in rows} == {"failed"}


def test_timed_batches_fail_at_their_deadline_across_a_restart(spark):
    from dataclasses import replace

    from quorate.streaming import timed

    at, config = shared.scratch(spark), replace(EngineConfig(), timeout_s=15, poll_s=1)
    put = lambda *rows: spark.createDataFrame(rows, timed.EVENT).coalesce(1).write.mode("append").json(f"{at}/in")
    event = lambda batch, kind, request=None, note=None: (batch, kind, request, "ok" if kind == "result" else None, note)
    start = lambda: timed.watch(spark.readStream.schema(timed.EVENT).json(f"{at}/in"), f"{at}/log", f"{at}/stream", config)

    def seen(n):
        for _ in range(160):
            if query.exception():
                raise query.exception()
            fs, path = shared.file_system(spark, f"{at}/log/_spark_metadata")
            rows = spark.read.schema(timed.OUTCOME).parquet(f"{at}/log").collect() if fs.exists(path) else []
            if len(rows) >= n:
                break
            time.sleep(0.5)
        return sorted(tuple(r) for r in rows)

    put(event("b1", "submitted", "a1"), event("b1", "submitted", "a2"), event("b2", "submitted", "a3"), event("b2", "submitted", "a4"), event("b2", "result", "a3", 2), event("b2", "result", "a99", 1))
    query = start()
    try:
        assert seen(1) == [("b2", "a3", "ok", 2, "result")]
        query.stop()
        put(event("b1", "result", "a1", 1), event("b1", "ended"))
        query = start()  # the timer of b2 was set before the restart
        want = [("b1", "a1", "ok", 1, "result"), ("b1", "a2", "failed", None, "ended"), ("b2", "a3", "ok", 2, "result"), ("b2", "a4", "failed", None, "deadline")]
        assert seen(4) == want
        put(event("b2", "result", "a4", 0), event("b2", "submitted", "a5"), event("b3", "submitted", "a6"), event("b3", "result", "a6", 0))
        assert seen(5) == [*want, ("b3", "a6", "ok", 0, "result")]
    finally:
        query.stop()
        spark.conf.unset(timed.STORE[0])
