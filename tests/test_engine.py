"""The engine from files to predictions, its cache, and the command line."""

import pytest

from glossarium.__main__ import main
from glossarium.operators.model import PairClassifier
from glossarium.plans.cache import Config
from glossarium.plans.engine import Engine


def corpus(folder, names):
    folder.mkdir()
    out = []
    for k in range(12):
        noun, verb = names[k % len(names)]
        lvc = noun.startswith("d")
        out += ["# text = t", f"1\tx\t{verb}\tVERB\t_\t_\t0\troot\t_\t_\t{'1' if lvc else '*'}", "2\ty\tle\tDET\t_\t_\t3\tdet\t_\t_\t*", f"3\tz\t{noun}\tNOUN\t_\t_\t1\t{'obj' if lvc else 'obl'}\t_\t_\t{'1:LVC.full' if lvc else '*'}", f"4\tq\tmot{k % 3}\tADJ\t_\t_\t3\tamod\t_\t_\t*", ""]
    (folder / "a.cupt").write_text("\n".join(out))
    return str(folder)


def test_engine(spark, tmp_path, capsys, monkeypatch):
    train = corpus(tmp_path / "train", [("décision", "prendre"), ("éponge", "jeter"), ("danse", "faire"), ("pierre", "lancer")])
    test = corpus(tmp_path / "test", [("décision", "prendre"), ("douche", "prendre"), ("pierre", "jeter")])
    whole = tmp_path / "whole"
    whole.mkdir()
    for k, d in enumerate((train, test)):
        (whole / f"{k}.cupt").write_text(open(f"{d}/a.cupt").read())
    config = Config(str(whole), train, test, str(tmp_path / "save"))
    engine = Engine(spark, config, dimensions=3, iterations=3)
    engine.train()
    predicted = {(r["noun"], r["verb"]) for r in engine.predict().collect()}
    assert {n for n, _ in predicted} <= {"douche", "pierre"}
    result = engine.evaluate()
    assert result["measures"].first()["recall"] > 0 and {"true_recall", "true_f1"} <= set(result["curve"].columns)
    assert result["confusion"].count() >= 1
    assert {(r["noun"], r["verb"]) for r in result["unseen_true"].collect()} == {("douche", "prendre")}

    before = engine.features().count()
    again = Engine(spark, config, 3, 3)
    assert again.features().count() == before  # read back
    monkeypatch.setattr(PairClassifier, "fit", lambda self, rows: pytest.fail("the kept classifier was not used"))
    assert again.fit().importances() == engine.fit().importances() and {(r["noun"], r["verb"]) for r in again.predict().collect()} == predicted
    monkeypatch.undo()
    fitted = []
    plain = PairClassifier.fit
    monkeypatch.setattr(PairClassifier, "fit", lambda self, rows: fitted.append(1) or plain(self, rows))
    again.fit()
    assert not fitted
    again.train(reset_classifier=True)
    assert fitted == [1]
    monkeypatch.undo()

    other = Engine(spark, config, dimensions=1, iterations=3)  # settings of its own: nothing of the other's is read
    assert len(other.features().first()["noun_vec"]) == 1 and len(engine.features().first()["noun_vec"]) == 3

    main(["-corpus_dir", str(whole), "-train_dir", train, "-test_dir", test, "-save_dir", config.save_dir, "-predict", "-eval", "-dimensions", "3", "-iterations", "2"])
    printed = capsys.readouterr().out.splitlines()
    assert "# measures" in printed and "# unseen_true" in printed and any(x.startswith("douche\tprendre\t") for x in printed)
    own = tmp_path / "save" / "notes"
    own.mkdir()
    (own / "a.txt").write_text("mine")
    (tmp_path / "save" / "b.txt").write_text("mine")
    engine.clear()
    assert sorted(x.name for x in (tmp_path / "save").iterdir()) == ["b.txt", "notes"]


def test_expressions_are_counted_once(spark, tmp_path, monkeypatch):
    """Pairs asked for again are read; of a longer list only the new ones are counted; pairs without any count are remembered too."""
    from glossarium.operators import cooc

    folder = corpus(tmp_path / "c", [("décision", "prendre"), ("pierre", "lancer"), ("danse", "faire")])
    engine = Engine(spark, Config(folder, folder, folder, str(tmp_path / "save")), dimensions=2)
    asked = []
    plain = cooc.expression_counts
    monkeypatch.setattr(cooc, "expression_counts", lambda t, *k, only: asked.append(sorted(tuple(r) for r in only.collect())) or plain(t, *k, only=only))
    wanted = lambda *p: spark.createDataFrame(list(p), "noun string, verb string")
    first = {tuple(r) for r in engine.expression_cooccurrences(wanted(("décision", "prendre"), ("no", "thing"))).collect()}
    assert {r[0] for r in first} == {"décision"} and asked == [[("décision", "prendre"), ("no", "thing")]]
    assert {tuple(r) for r in engine.expression_cooccurrences(wanted(("décision", "prendre"), ("no", "thing"))).collect()} == first and len(asked) == 1
    both = {tuple(r) for r in engine.expression_cooccurrences(wanted(("décision", "prendre"), ("pierre", "lancer"))).collect()}
    assert asked[1:] == [[("pierre", "lancer")]] and first < both and {r[0] for r in both} == {"décision", "pierre"}
    whole = {tuple(r) for r in plain(engine.tokens(folder), "file", "sid").collect()}
    assert both == {r for r in whole if r[0] != "danse"}
    one = engine.expression_vectors(wanted(("décision", "prendre"))).collect()
    two = engine.expression_vectors(wanted(("décision", "prendre"), ("danse", "faire"))).collect()
    assert one[0] in two and len(two) == 2


def test_a_stop_between_any_two_writes_changes_nothing(spark, tmp_path, monkeypatch):
    """The table that a call finds after a stop is the one before, and the next call makes it whole; no row stands twice."""
    from pyspark.sql import DataFrameWriter

    from glossarium.plans import cache

    wanted = lambda *k: spark.createDataFrame([(x, "v") for x in k], "noun string, verb string")
    build = lambda new: new.filter("noun <> 'none'").withColumn("n", new["noun"])
    rows = lambda df: sorted(r["noun"] for r in df.collect())
    plain, stops = DataFrameWriter.parquet, {"at": 0}

    class Stop(Exception):
        pass

    def parquet(self, path, *a, **b):
        stops["at"] -= 1
        if stops["at"] == 0:
            raise Stop
        plain(self, path, *a, **b)
        stops["at"] -= 1
        if stops["at"] == 0:
            raise Stop

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    for at in range(1, 7):
        path = f"{tmp_path}/t{at}"
        assert rows(cache.extended(spark, path, wanted("a", "none"), build)) == ["a"]
        stops["at"] = at
        if at == 5:
            monkeypatch.setattr(cache, "_commit", lambda *x: (_ for _ in ()).throw(Stop))
        try:
            cache.extended(spark, path, wanted("a", "b", "none"), build)
        except Stop:
            pass
        stops["at"] = 0
        if at == 5:
            monkeypatch.undo()
            monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
        assert rows(cache.extended(spark, path, wanted("a", "b", "c", "none"), build)) == ["a", "b", "c"]
        assert rows(cache.extended(spark, path, wanted("b", "c"), build)) == ["b", "c"]


def test_of_two_that_add_at_once_one_commits(spark, tmp_path):
    """A build in the middle of which the same keys are added by another: they stand once.  An empty commit counts for nothing."""
    from glossarium.plans import cache

    path, wanted = f"{tmp_path}/t", spark.createDataFrame([("a", "v"), ("b", "v")], "noun string, verb string")
    other = []

    def build(new):
        if not other:
            other.append(1)
            cache.extended(spark, path, wanted.filter("noun = 'a'"), lambda x: x)
        return new

    assert sorted(r["noun"] for r in cache.extended(spark, path, wanted, build).collect()) == ["a", "b"]
    fs, p = cache._fs(spark, f"{path}/commits/00000009")
    fs.create(p, False).close()
    more = spark.createDataFrame([("c", "v")], "noun string, verb string").unionByName(wanted)
    assert sorted(r["noun"] for r in cache.extended(spark, path, more, lambda x: x).collect()) == ["a", "b", "c"]


def test_added_files_are_parsed_alone(spark, tmp_path, monkeypatch):
    """Adding or changing a file gives what a new run over all of them gives, and only that file is read."""
    from pathlib import Path

    from glossarium.plans import engine as module

    folder = corpus(tmp_path / "c", [("décision", "prendre"), ("pierre", "lancer")])
    engine = Engine(spark, Config(folder, folder, folder, str(tmp_path / "save")), dimensions=2)
    whole = lambda e: sorted((Path(r["file"]).name, r["sid"], r["noun"], r["verb"]) for r in e.arcs(folder).collect())
    before, read, plain = whole(engine), [], module.read_corpus
    monkeypatch.setattr(module, "read_corpus", lambda s, names: read.append(sorted(Path(x).name for x in names)) or plain(s, names))
    (Path(folder) / "b.cupt").write_text(Path(f"{folder}/a.cupt").read_text().replace("pierre", "mot"))
    assert len(whole(engine)) == 2 * len(before) and read == [["b.cupt"]]
    (Path(folder) / "a.cupt").write_text(Path(f"{folder}/b.cupt").read_text().replace("mot", "chose") + "\n")
    after = whole(engine)
    assert read == [["b.cupt"], ["a.cupt"]] and {x[2] for x in after} == {"décision", "mot", "chose"}
    assert after == whole(Engine(spark, Config(folder, folder, folder, str(tmp_path / "other")), dimensions=2))
