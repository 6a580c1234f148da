"""Hand-computed micro-corpora for the source, the arcs, the features, the patterns, co-occurrence, truth and evaluation."""

import math
import random

import pytest
from pyspark.sql import functions as F

from glossarium.operators import cooc, evaluate, pairs, patterns, truth, vectors
from glossarium.sources import conllu


def line(i, form, lemma, upos, head, rel, mwe=None):
    cells = [str(i), form, lemma, upos, "_", "_", str(head), rel, "_", "_"]
    return "\t".join(cells + ([mwe] if mwe else []))


FILE_A = "\n".join([
    "# text = un", line(1, "prend", "prendre", "VERB", 0, "root", "1"), line(2, "une", "un", "DET", 3, "det", "*"), line(3, "décision", "décision", "NOUN", 1, "obj", "1:LVC.full"),
    "", line(4, "suite", "suite", "NOUN", 1, "nsubj", "*"),  # a blank line does not end the sentence
    "# text = a", "# text = b", line(1, "jette", "jeter", "VERB", 0, "root", "2"), line(2, "éponge", "éponge", "NOUN", 1, "obl:arg", "2:VID"), line("3-4", "du", "_", "ADP", 1, "case", "*"), line("5.1", "x", "x", "X", 1, "dep", "_"), line(3, "a#b", "ab", "NOUN", 1, "obj", "*"),
    "# text = c", line(1, "va", "aller", "VERB", 0, "root", "*"), line(2, "!x", "!x", "NOUN", 1, "obj", "*"),
    "# text = d", line(1, "été", "été", "NOUN", 2, "nsubj", "*"), line(2, "passe", "passer", "VERB", 0, "root", "*"),
])
FILE_B = "\n".join([line(1, "prend", "prendre", "VERB", 0, "root", "1:LVC.cause"), line(2, "temps", "temps", "NOUN", 1, "obj", "1"), "# text = z", line(1, "prend", "prendre", "VERB", 0, "root", "1:LVC.full"), line(2, "temps", "temps", "NOUN", 1, "obj", "1"), line(3, "décision", "décision", "NOUN", 1, "obj", "1"), ""])


@pytest.fixture(scope="module")
def tokens(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    (folder / "a.cupt").write_text(FILE_A)
    (folder / "b.cupt").write_text(FILE_B)
    return conllu.read_corpus(spark, str(folder)).withColumn("file", F.element_at(F.split("file", "/"), -1)).withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("id", "head")}).persist()


def test_parser(tokens):
    rows = {(r["file"], r["sid"], r["id"]): r["lemma"] for r in tokens.collect()}
    assert rows == {
        ("a.cupt", 1, 1): "prendre", ("a.cupt", 1, 2): "un", ("a.cupt", 1, 3): "décision", ("a.cupt", 1, 4): "suite", ("a.cupt", 2, 1): "jeter", ("a.cupt", 2, 2): "éponge", ("a.cupt", 2, 5.1): "x",
        ("a.cupt", 4, 1): "été", ("a.cupt", 4, 2): "passer", ("b.cupt", 0, 1): "prendre", ("b.cupt", 0, 2): "temps", ("b.cupt", 1, 1): "prendre", ("b.cupt", 1, 2): "temps", ("b.cupt", 1, 3): "décision",
    }


def test_missing_annotation_column_is_null(spark):
    lines = spark.createDataFrame([("f", 0, "# text"), ("f", 1, line(1, "a", "a", "NOUN", 0, "root"))], "file string, line_no int, value string")
    assert [r["mwe"] for r in conllu.parse_tokens(lines).collect()] == [None]


def test_sentences(spark):
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(FILE_A.split("\n"))], "file string, line_no int, value string")
    assert {(r["sid"], r["text"]) for r in conllu.parse_sentences(lines).collect()} == {(1, "un"), (2, "a"), (2, "b"), (3, "c"), (4, "d")}


def test_blocks_and_splits_change_nothing(spark, tmp_path, monkeypatch):
    """Sentences that run over blocks of lines, and files that are read in splits of a few bytes."""
    text = "\n".join([FILE_A] * 7) + "\n"
    lines = spark.createDataFrame([("f", k, v) for k, v in enumerate(text.split("\n"))], "file string, line_no int, value string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    whole, said = rows(conllu.parse_tokens(lines)), rows(conllu.parse_sentences(lines))
    for bits in (0, 1, 3):
        monkeypatch.setattr(conllu, "BLOCK", bits)
        assert rows(conllu.parse_tokens(lines)) == whole and rows(conllu.parse_sentences(lines)) == said
    (tmp_path / "c").mkdir()
    for name in ("f", "g"):
        (tmp_path / "c" / name).write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 300)
    read = conllu.read_lines(spark, str(tmp_path / "c"))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name in ("f", "g"):
        own = read.filter(F.col("file").endswith(name)).orderBy("line_no").collect()
        assert [(r["line_no"], r["value"]) for r in own] == list(enumerate(text.split("\n")[:-1]))


def test_arcs_and_truth(tokens):
    arcs = pairs.arcs(tokens, "file", "sid")
    assert {(r["noun"], r["verb"], r["deprel"]) for r in arcs.collect()} == {("décision", "prendre", "obj"), ("suite", "prendre", "nsubj"), ("éponge", "jeter", "obl:arg"), ("été", "passer", "nsubj"), ("temps", "prendre", "obj")}
    assert {tuple(r) for r in truth.constructions(tokens, "file", "sid").collect()} == {("décision", "prendre"), ("temps", "prendre")}


def test_association_by_hand(spark):
    arcs = spark.createDataFrame([("décision", "prendre", 3, 1, "obj")] * 2 + [("décision", "prendre", 1, 5, "nsubj"), ("temps", "prendre", 2, 1, "obl:arg")] + [("temps", "passer", 2, 1, "obj")] * 2, "noun string, verb string, noun_id long, verb_id long, deprel string")
    r = pairs.association(arcs).filter("noun = 'décision'").first()
    expected = {"p": 1 / 2, "p_n": 1 / 2, "p_v": 2 / 3, "p_n_given_v": 3 / 4, "p_v_given_n": 1, "v_n": 1 / 4, "v_v": 2 / 9, "v": 1 / 6, "corr": 1 / math.sqrt(2), "pmi": math.log(1.5), "dist": 8 / 3, "p_obj": 2 / 3, "p_subj": 1 / 3, "p_obl": 0, "p_other": 0}
    for k, v in expected.items():
        assert r[k] == pytest.approx(v, abs=1e-12), k
    assert pairs.association(arcs).filter("noun = 'temps' and verb = 'prendre'").first()["p_other"] == 1


def test_one_pair_has_no_correlation(spark):
    arcs = spark.createDataFrame([("a", "b", 1, 2, "obj")], "noun string, verb string, noun_id long, verb_id long, deprel string")
    assert pairs.association(arcs).first()["corr"] == 0


def test_patterns(tokens):
    found = patterns.between(tokens, pairs.arcs(tokens, "file", "sid"), "file", "sid")
    assert sorted(r["pattern"] for r in found.collect()) == sorted(["DET", "DET|NOUN", "", "", "", "", "NOUN"])
    assert [(r["pattern"], r["cnt"]) for r in patterns.most_frequent(found, 2).collect()] == [("", 4), ("DET", 1)]
    freq = {(r["noun"], r["pattern"]): r["freq"] for r in patterns.frequencies(found, 5).collect()}
    assert freq["décision", "DET"] == freq["décision", "NOUN"] == 0.5


def test_patterns_of_long_sentences(spark, monkeypatch):
    """Blocks of a few tags, ids with gaps and halves, tokens without a tag; and a sentence of a million tokens."""
    monkeypatch.setattr(patterns, "BLOCK", 3)
    r = random.Random(2)
    rows, arcs, want = [], [], []
    for sid in range(6):
        ids = sorted(r.sample(range(1, 60), 2 + 7 * sid)) + [70.5]
        tags = {float(i): r.choice(["DET", "ADJ", "NOUN", None]) for i in ids}
        rows += [(sid, i, t) for i, t in tags.items()]
        for k in range(9):
            a, b = r.sample(sorted(tags), 2)
            arcs.append((sid, f"n{k}", "v", a, b))
            want.append((sid, f"n{k}", "|".join(t for i, t in sorted(tags.items()) if min(a, b) < i < max(a, b) and t)))
    found = patterns.between(spark.createDataFrame(rows, "sid int, id double, upos string"), spark.createDataFrame(arcs, "sid int, noun string, verb string, noun_id double, verb_id double"), "sid")
    assert sorted((x["sid"], x["noun"], x["pattern"]) for x in found.collect()) == sorted(want)
    monkeypatch.undo()
    n = 1_000_000
    tokens = spark.range(1, n + 1).selectExpr("1 as sid", "id", "if(id % 7 = 0, 'ADP', 'DET') as upos")
    pairs_ = spark.range(1, n - 10, 3).selectExpr("1 as sid", "'n' as noun", "'v' as verb", "id as noun_id", "id + 1 + id % 5 as verb_id").unionByName(spark.createDataFrame([(1, "n", "v", n, 1)], "sid int, noun string, verb string, noun_id long, verb_id long"))
    got = patterns.between(tokens, pairs_, "sid", dense=True).selectExpr("noun_id", "length(pattern) as size", "if(noun_id = 7, pattern, null) as said", "hash(pattern)").collect()
    assert len(got) == pairs_.count() and {x["said"] for x in got if x["noun_id"] == 7} == {"DET|DET"} and max(x["size"] for x in got) == 4 * (n - 2) - 1


@pytest.mark.parametrize("sizes", [(1 << 16, 256), (64, 4), (4, 2)])
def test_most_frequent_by_buckets(spark, monkeypatch, sizes):
    """Buckets that many patterns share, all patterns alike, fewer patterns than asked for, ties."""
    monkeypatch.setattr(patterns, "BUCKETS", sizes[0])
    monkeypatch.setattr(patterns, "FULLEST", sizes[1])
    r = random.Random(1)
    for rows in ([f"p{int(r.expovariate(0.05))}" for _ in range(3000)], [f"p{k}" for k in range(300)], ["a", "b", "a"], [], ["x"] * 50 + [f"p{k // 2}" for k in range(200)]):
        count = {p: rows.count(p) for p in set(rows)}
        found = spark.createDataFrame([(p,) for p in rows], "pattern string").repartition(3)
        got = [(x["pattern"], x["cnt"]) for x in patterns.most_frequent(found, 20).collect()]
        assert got == sorted(count.items(), key=lambda x: (-x[1], x[0]))[:20]


def test_expressions_of_long_sentences(spark, monkeypatch):
    """Pieces of a few words and expressions change nothing; ids that repeat; only some pairs."""
    r = random.Random(4)
    rows = [(sid, i, f"w{r.randrange(9)}", r.choice(["NOUN", "VERB", "ADJ"]), r.randrange(0, 30)) for sid in range(8) for i in range(1, 4 + 4 * sid)] + [(9, 1, "a", "VERB", 0), (9, 1, "b", "VERB", 0), (9, 2, "c", "NOUN", 1)]
    tokens = spark.createDataFrame(rows, "sid int, id long, lemma string, upos string, head long")
    want = {}
    for sid in {x[0] for x in rows}:
        own = [x for x in rows if x[0] == sid]
        nouns, verbs = {}, {}
        for _, i, w, tag, head in own:
            if tag == "NOUN":
                nouns[w] = max(nouns.get(w, (0, 0)), (i, head))
            if tag == "VERB":
                verbs[w] = max(verbs.get(w, 0), i)
        for n, (_, head) in nouns.items():
            for v in (v for v, at in verbs.items() if at == head):
                for x in own:
                    if x[2] not in (n, v):
                        want[n, v, x[2]] = want.get((n, v, x[2]), 0) + 1
    for size in (512, 2):
        monkeypatch.setattr(cooc, "PIECE", size)
        assert {tuple(x)[:3]: x["c"] for x in cooc.expression_counts(tokens, "sid").collect()} == want
    some = spark.createDataFrame([k[:2] for k in want][::3], "noun string, verb string").distinct()
    kept = {tuple(x) for x in some.collect()}
    assert {tuple(x)[:3]: x["c"] for x in cooc.expression_counts(tokens, "sid", only=some).collect()} == {k: c for k, c in want.items() if k[:2] in kept}


def test_arcs_without_a_join(spark):
    """The lemma that a token carries gives the arcs that a join by head gives."""
    from glossarium.operators import annotate

    ann = annotate.annotate(spark.createDataFrame([(1, "Abcd efghi jklm. Abcd efgh ab nopqr stuv efghi. uvwx ab"), (2, None)], "doc_id long, text string"))
    plan = pairs.arcs(ann, "doc_id", "sid")._jdf.queryExecution().executedPlan().toString()
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(pairs.arcs(ann, "doc_id", "sid")) == rows(pairs.arcs(ann.drop("head_lemma"), "doc_id", "sid")) != [] and "Join" not in plan


def test_cooccurrence(spark):
    t = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "a"), (2, "c")], "sid int, lemma string")
    c = cooc.counts(t, "sid")
    assert {(r["w1"], r["w2"]): r["c"] for r in c.collect()} == {("a", "b"): 2, ("b", "a"): 2, ("a", "a"): 2, ("a", "c"): 1, ("c", "a"): 1}
    total = {}
    for r in cooc.normalised(c).collect():
        total[r["w2"]] = total.get(r["w2"], 0) + r["v"]
    assert all(v == pytest.approx(1) for v in total.values())


def test_long_sentences_are_dealt_out(spark, monkeypatch):
    import random

    r = random.Random(1)
    t = spark.createDataFrame([(s, f"w{r.randrange(40)}") for s in (1, 2, 3) for _ in range(90)] + [(4, "w1")], "sid int, lemma string")
    whole = sorted(map(tuple, cooc.counts(t, "sid").collect()))
    sums = sorted(map(tuple, cooc.row_sums(cooc.counts(t, "sid")).collect()))
    assert sorted(map(tuple, cooc.token_row_sums(t, "sid").collect())) == sums
    monkeypatch.setattr(cooc, "PIECE", 7)
    assert sorted(map(tuple, cooc.counts(t, "sid").collect())) == whole


def test_expressions_use_last_occurrences(spark):
    rows = [(1, 1.0, "v", "VERB", 0.0), (1, 2.0, "n", "NOUN", 1.0), (1, 3.0, "v", "VERB", 0.0), (1, 4.0, "w", "ADJ", 0.0), (2, 1.0, "v", "VERB", 0.0), (2, 2.0, "n", "NOUN", 1.0), (2, 3.0, "w", "ADJ", 0.0), (2, 4.0, "w", "ADJ", 0.0)]
    t = spark.createDataFrame(rows, "sid int, id double, lemma string, upos string, head double")
    assert [tuple(r) for r in cooc.expression_counts(t, "sid").collect()] == [("n", "v", "w", 2)]


def test_svd_against_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    m = r.integers(1, 9, (7, 7))
    m = m + m.T
    c = spark.createDataFrame([(f"w{i}", f"w{j}", int(m[i, j])) for i in range(7) for j in range(7)], "w1 string, w2 string, c long")
    space = vectors.LatentSpace(c, 3)
    a = m / m.sum(axis=1)[None, :]
    u, s, _ = np.linalg.svd(a)
    assert np.allclose(space.singular_values, s[:3])
    got = {x["word"]: x["vec"] for x in space.word_vectors.collect()}
    assert np.allclose(np.abs(np.array([got[f"w{i}"] for i in range(7)])), np.abs(u[:, :3] * s[:3]), atol=1e-9)


def test_svd_of_several_blocks(spark):
    """700 words are three blocks; every word has a vector, and expressions are projected on the same dimensions."""
    import numpy as np

    r = np.random.default_rng(2)
    m = np.triu(r.integers(1, 9, (700, 700)) * (r.random((700, 700)) < 0.05))
    m[0] = 40
    m = m + m.T
    c = spark.createDataFrame([(f"w{i:03}", f"w{j:03}", int(m[i, j])) for i, j in zip(*map(list, m.nonzero()), strict=True)], "w1 string, w2 string, c long")
    space = vectors.LatentSpace(c, 690)
    a = m / m.sum(axis=1)[None, :]
    _, s, v = np.linalg.svd(a)
    assert np.allclose(space.singular_values, s[:690], atol=1e-7) and len(space.singular_values) == 690
    got = {x["word"]: x["vec"] for x in space.word_vectors.collect()}
    assert len(got) == 700 and np.allclose(np.abs(got["w003"][:5]), np.abs(v[:5] @ a[3]), atol=1e-6)
    exprs = space.expressions(spark.createDataFrame([("n", "v", "w001", 0.5), ("n", "v", "w650", 2.0), ("n", "u", "w300", 1.0)], "noun string, verb string, word string, v double"))
    said = {x["verb"]: x["vec"] for x in exprs.collect()}
    assert set(said) == {"u", "v"} and np.allclose(np.abs(said["v"][:5]), np.abs(0.5 * v[:5, 1] + 2 * v[:5, 650]), atol=1e-6)


def test_evaluation(spark):
    rows = [("a", "v", "YES", "YES", 0.9), ("b", "v", "NO", "YES", 0.9), ("c", "v", "YES", "NO", 0.2), ("d", "v", "NO", "NO", 0.1)]
    scored = spark.createDataFrame(rows, "noun string, verb string, is_lvc string, prediction string, score double")
    m = evaluate.measures(scored, spark.createDataFrame([(4,)], "nb_tot long")).first()
    assert (m["precision"], m["recall"], m["f1"], m["kappa"], m["true_recall"]) == (0.5, 0.5, 0.5, 0.0, 0.25)
    curve = {r["threshold"]: (r["precision"], r["recall"]) for r in evaluate.curve(scored).collect()}
    assert curve == {0.9: (0.5, 0.5), 0.2: (pytest.approx(2 / 3), 1.0), 0.1: (0.5, 1.0)}
    whole = {r["threshold"]: (r["precision"], r["true_recall"], r["true_f1"]) for r in evaluate.curve(scored, spark.createDataFrame([(4,)], "nb_tot long")).collect()}
    assert whole == {0.9: (0.5, 0.25, pytest.approx(1 / 3)), 0.2: (pytest.approx(2 / 3), 0.5, pytest.approx(4 / 7)), 0.1: (0.5, 0.5, 0.5)}


def test_empty_and_null_input(spark):
    from glossarium.operators import annotate

    docs = spark.createDataFrame([(1, None), (2, ""), (None, "Abcd efghi.")], "doc_id long, text string")
    ann = annotate.annotate(docs)
    assert {r["lemma"] for r in ann.collect()} == {"abcd", "efghi"}
    none = pairs.arcs(ann.filter("false"), "doc_id", "sid")
    assert pairs.association(none).collect() == []
    assert evaluate.measures(spark.createDataFrame([], "prediction string, is_lvc string")).first()["f1"] == 0
