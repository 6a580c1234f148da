"""The whole analysis over annotated corpora: features, training, prediction, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cooc, evaluate, pairs, patterns, truth, vectors
from ..operators.model import PairClassifier
from ..sources.conllu import read_corpus
from .cache import Config, clear, exists, extended, materialize, remove

SENTENCE = ("file", "sid")


class Engine:
    """Each step is written once under save_dir and read from there afterwards, by this or a later process, until it is reset."""

    def __init__(self, spark: SparkSession, config: Config, dimensions: int = 100, iterations: int = 500, booster: str = "leaves") -> None:
        self.spark, self.config, self.dimensions, self.iterations, self.booster = spark, config, dimensions, iterations, booster
        self._model: PairClassifier | None = None
        self._space: vectors.LatentSpace | None = None

    def _kept(self, name: str, of: tuple, build: Callable[[], DataFrame], reset: bool = False) -> DataFrame:
        return materialize(self.spark, self.config.path(name, *of), build, reset)

    def files(self, folder: str) -> DataFrame:
        """(file, stamp) of the folder's files; a file that is written anew has another stamp."""
        found = self.spark.read.format("binaryFile").load(folder)
        return found.select(F.col("_metadata.file_path").alias("file"), F.concat_ws("-", F.unix_micros("_metadata.file_modification_time"), "_metadata.file_size").alias("stamp"))

    def _state(self, folder: str) -> str:
        """A digest of the folder's files, by which what is made from all of them is kept."""
        return self.files(folder).agg(F.sum(F.xxhash64("file", "stamp").cast("decimal(20,0)")).alias("s"), F.count("*").alias("n")).select(F.concat_ws("-", "n", "s")).first()[0]

    def tokens(self, folder: str, reset: bool = False) -> DataFrame:
        """Tokens of the folder's files; each file is parsed once, so that files that are added later are parsed alone."""
        path = self.config.path("tokens", folder)
        if reset:
            remove(self.spark, path)

        def build(new: DataFrame) -> DataFrame:
            names = [r["file"] for r in new.select("file").collect()]  # names of files, as a listing has them
            t = read_corpus(self.spark, names) if names else read_corpus(self.spark, folder).limit(0)
            t = t.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("id", "head")}).filter("id is not null")
            return t.join(F.broadcast(new), "file")  # a row a file

        return extended(self.spark, path, self.files(folder), build, ("file", "stamp"))

    def arcs(self, folder: str, reset: bool = False) -> DataFrame:
        """Arcs, likewise by files."""
        path = self.config.path("arcs", folder)
        if reset:
            remove(self.spark, path)
        build = lambda new: pairs.arcs(self.tokens(folder).join(F.broadcast(new), ["file", "stamp"]), *SENTENCE, "stamp")  # noqa: E731  a row a file
        return extended(self.spark, path, self.files(folder), build, ("file", "stamp"))

    def candidates(self, folder: str) -> DataFrame:
        return pairs.candidates(self.arcs(folder))

    def cooccurrences(self, reset: bool = False) -> DataFrame:
        folder = self.config.corpus_dir
        return self._kept("cooc", (folder, self._state(folder)), lambda: cooc.counts(self.tokens(folder), *SENTENCE), reset)

    def space(self) -> vectors.LatentSpace:
        if self._space is None:
            self._space = vectors.LatentSpace(self.cooccurrences(), self.dimensions)
        return self._space

    def expression_cooccurrences(self, wanted: DataFrame) -> DataFrame:
        """(noun, verb, word, c) of the pairs `wanted`; counted once for each pair and kept."""
        folder = self.config.corpus_dir
        return extended(self.spark, self.config.path("expressions", folder, self._state(folder)), wanted, lambda new: cooc.expression_counts(self.tokens(folder), *SENTENCE, only=new))

    def expression_vectors(self, wanted: DataFrame) -> DataFrame:
        """(noun, verb, vec) of the pairs `wanted` that have one; computed once for each pair and kept, for one latent space."""
        path = self.config.path("expression_vectors", self.config.corpus_dir, self._state(self.config.corpus_dir), self.dimensions, self.space().key)

        def build(new: DataFrame) -> DataFrame:
            sums = cooc.row_sums(self.cooccurrences())
            return self.space().expressions(cooc.expression_weights(self.expression_cooccurrences(new), sums))

        return extended(self.spark, path, wanted, build)

    def features(self, reset: bool = False) -> DataFrame:
        """All features of the corpus' candidates; the pattern columns stand for the twenty commonest patterns."""
        folder = self.config.corpus_dir

        def build() -> DataFrame:
            if reset:
                remove(self.spark, self.config.path("expressions", folder, self._state(folder)))
                self._space = None
            t = self.tokens(folder, reset)
            arcs = self.arcs(folder, reset)
            between = self._kept("between", (folder, self._state(folder)), lambda: patterns.between(t, arcs, *SENTENCE), reset)
            top = [r["pattern"] for r in patterns.most_frequent(between).collect()]  # at most twenty
            self.cooccurrences(reset)
            table = patterns.matrix(pairs.association(arcs), patterns.frequencies(between), top)
            space = self.space()
            return vectors.with_vector_features(table, space.word_vectors, self.expression_vectors(self.candidates(folder)), len(space.singular_values))

        return self._kept("features", (folder, self._state(folder), self.dimensions), build, reset)

    def labelled(self, folder: str) -> DataFrame:
        """Features of the folder's candidates with is_lvc from the folder's own annotation."""
        return truth.label(truth.restricted(self.features(), self.candidates(folder)), truth.constructions(self.tokens(folder), *SENTENCE))

    def _columns(self, rows: DataFrame) -> list[str]:
        return [c for c, kind in rows.dtypes if kind in ("double", "bigint") and c not in ("noun", "verb")]

    def fit(self, reset: bool = False) -> PairClassifier:
        """The classifier: the one kept for these corpora and settings, or a new one."""
        path = self.config.path("classifier", self.config.corpus_dir, self._state(self.config.corpus_dir), self.config.train_dir, self._state(self.config.train_dir), self.dimensions, self.iterations, self.booster)
        if reset:
            self._model = None
            remove(self.spark, path)
        if self._model is None and exists(self.spark, f"{path}/settings/_SUCCESS"):
            self._model = PairClassifier.load(self.spark, path)
        if self._model is None:
            rows = self.labelled(self.config.train_dir)
            self._model = PairClassifier(self._columns(rows), self.iterations, booster=self.booster).fit(rows)
            self._model.save(self.spark, path)
        return self._model

    def train(self, reset_features: bool = False, reset_classifier: bool = False) -> PairClassifier:
        """New features make a new classifier as well."""
        self.features(reset_features)
        return self.fit(reset_classifier or reset_features)

    def predict(self) -> DataFrame:
        """Pairs of the corpus predicted to be light-verb constructions that are not in the training corpus."""
        found = self.fit().predict(self.features())
        return truth.unseen(found, self.candidates(self.config.train_dir)).filter("prediction = 'YES'")

    def scored(self) -> DataFrame:
        """(noun, verb, is_lvc, prediction, score) of the test corpus."""
        rows = self.labelled(self.config.test_dir)
        return rows.select("noun", "verb", "is_lvc").join(self.fit().predict(rows), ["noun", "verb"]).withColumnRenamed("p_yes", "score")

    def evaluate(self) -> dict[str, DataFrame]:
        """measures, measures of the pairs not trained on, those of them that are constructions with what was predicted, confusion,
        curve and importances."""
        scored = self.scored()
        size = truth.constructions(self.tokens(self.config.test_dir), *SENTENCE).agg(F.count("*").alias("nb_tot"))
        fresh = truth.unseen(scored, self.candidates(self.config.train_dir))
        importances = self.spark.createDataFrame(sorted(self.fit().importances().items(), key=lambda x: -x[1]), "feature string, importance double")
        return {
            "measures": evaluate.measures(scored, size), "unseen": evaluate.measures(fresh), "unseen_true": fresh.filter("is_lvc = 'YES'").select("noun", "verb", "prediction", "score"),
            "confusion": evaluate.confusion(fresh), "curve": evaluate.curve(scored, size), "importances": importances,
        }

    def clear(self) -> None:
        """Remove what the engine has kept; other files of the folder stay."""
        clear(self.spark, self.config.save_dir)
        self._model = self._space = None
