"""Secret scan with a random forest that removes false positives (DataFrame and Spark ML functions only).

Candidates are long runs of key characters with letters and digits, whatever stands behind a key word and `=`, `:` or `is`, of any
length, and the password of a URL.  Key words are those of English, French, German and Spanish.  A forest judges each by its length, its transitions between kinds of characters and between letters, how much of it words of a
dictionary cover, whether it looks like a path, and the words around it.  The dictionary and the usual pairs of letters are
counted over all texts.  The forest is trained from labelled findings: lines of text, each with the secret in it, if any.
"""

from __future__ import annotations

import random
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, by_row, fresh, named, row_key

#: What a candidate by shape is made of, and its least length (behind a key or in a URL there is none); words looked at on either side.
CHARS, LEAST, AROUND = "A-Za-z0-9+/_\\-", 12, 4
#: Trees and their depth; words of the dictionary; lines of either label that labelled_lines() makes up.
TREES, DEPTH, WORDS, LINES = 40, 9, 4000, 3000
#: Words that stand before secrets (the short ones only as words of their own), words that stand before other long
#: strings, and fragments of placeholders.
KEYS = "password passwd secret token apikey api_key api-key access_key access-key authorization bearer credential private_key passphrase".split()
KEYS += ["mot de passe", "motdepasse", "mot_de_passe", "jeton", "identifiant secret", "passwort", "kennwort", "zugangsschlüssel", "geheimnis", "contraseña", "contrasena", "clave", "secreto", "credencial"]
SHORT_KEYS = "pass pwd auth key pin mdp clé cle schlüssel pw".split()
OTHERS = "commit sha sha1 sha256 md5 hash digest checksum uuid guid id ref revision version etag integrity isbn doi build example sample order invoice session".split()
FRAGMENTS = "example sample test dummy fake your change replace insert placeholder password secret token user name admin default demo here value none null todo redacted xxxx".split()
_KEY = f"(?:{'|'.join(KEYS)}|(?<!\\p{{L}})(?:{'|'.join(SHORT_KEYS)}))"
SHAPE = f"(?<![{CHARS}])(?=[{CHARS}]*[0-9])(?=[{CHARS}]*[A-Za-z])[{CHARS}]{{{LEAST},}}={{0,2}}"
_VALUE = "[\"'`(\\[{<]*([^\\s\"'`,;)\\]}>]+)"
#: The password of a URL: `://user:value@host`; it may hold any of these marks, the host begins behind the last one.
URL = "://[^\\s/:@\"'<>]*:([^\\s/\"'<>]+)@[A-Za-z0-9\\[]"
#: A value behind its key in one word; a key at the end of the words before; a value at the start of a word.
_IS = "is|est|ist|es|lautet"
#: Up to two words between a key and its `=`.
_OF = "(?:[^\\p{L}=:]+\\p{L}+){0,2}"
INSIDE, BEFORE, START = f"(?iu){_KEY}[\"'`\\])]*[=:]+>?{_VALUE}", f"{_KEY}(?:[\"'`\\])]*\\s*(?:[=:]+>?|\\s(?:{_IS}))|{_OF}\\s*=+>?)[\"'`]*$", f"^{_VALUE}"
#: What a short value must stand behind to be replaced.
LEADS = f"(?iu)({_KEY}(?:[\"'`\\])]*\\s*(?:[=:]+>?|\\s(?:{_IS})\\s)|{_OF}\\s*=+>?)\\s*[\"'`(\\[{{<]*|://[^\\s/:@\"'<>]*:)"
ANYWHERE = f"{SHAPE}|{URL}|(?iu:{_KEY}(?:[\"'`\\])]*\\s*(?:[=:]|\\s(?:{_IS})\\s)|{_OF}\\s*=))"
FEATURES = [
    "length", "digits", "upper", "symbols", "hexadecimal", "only_digits", "changes", "case_changes", "usual_pairs", "distinct", "vowels", "covered", "fragments", "path", "address", "template", "reference", "dated",
    "dashes", "known", "header", "key_word", "other_word", "assigned", "quoted", "in_url", "groups",
]


@dataclass(frozen=True)
class Model:
    """A forest, and what its features need: the dictionary and the usual pairs of letters."""

    forest: RandomForestClassificationModel
    words: list[str]
    pairs: list[str]


def dictionary(docs: DataFrame, text_col: str = "text", size: int = WORDS) -> tuple[list[str], list[str]]:
    """The `size` commonest words (three letters of a-z or more) of all texts, and the pairs of letters that make up nine tenths of them."""
    each = docs.select(F.explode(F.split(F.lower(named(text_col).cast("string")), "[^a-z]+")).alias("w")).filter(F.length("w") >= 3)
    top = each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(size).collect()  # `size` rows
    seen: Counter[str] = Counter()
    for r in top:
        for a, b in zip(r["w"], r["w"][1:], strict=False):
            seen[a + b] += r["count"]
    pairs, left = [], 0.9 * sum(seen.values())
    for pair, n in sorted(seen.items(), key=lambda x: (-x[1], x[0])):
        if left <= 0:
            break
        pairs.append(pair)
        left -= n
    return [r["w"] for r in top], pairs


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, word_at, value, word, before, after) of every candidate; row is a row_key(), a null text has none."""
    text = docs.select(row_key(id_col, text_col).alias("row"), named(text_col).cast("string").alias("text")).filter(F.col("text").rlike(ANYWHERE))
    words = text.select("row", F.array_remove(F.split("text", SPACES), "").alias("words"))
    each = words.select("row", "words", F.posexplode_outer("words").alias("word_at", "word"))
    at, word = F.col("word_at"), F.col("word")
    near = F.lower(F.concat_ws(" ", *(F.get("words", at - k) for k in range(AROUND, 0, -1))))
    led = word.rlike(START) & F.get("words", at - 1).rlike(f"(?i)(?:[=:]>?|^(?:{_IS}))[\"'`]*$") & near.rlike(BEFORE)
    each = each.filter(word.rlike(SHAPE) | word.rlike(INSIDE) | word.rlike(URL) | led)
    behind = F.when(word.rlike(URL), F.regexp_extract("word", URL, 1)).when(word.rlike(INSIDE), F.regexp_extract("word", INSIDE, 1)).when(led, F.regexp_extract("word", START, 1)).otherwise("")
    each = each.withColumn("behind", F.regexp_replace(behind, "[.,:]+$", "")).withColumn("shapes", F.regexp_extract_all("word", F.lit(SHAPE), F.lit(0)))
    other = F.filter("shapes", lambda x: ~F.contains(F.col("behind"), x))
    values = F.when(F.col("behind") == "", F.col("shapes")).otherwise(F.concat(F.array("behind"), other))
    before, after = F.slice("words", F.greatest(at - (AROUND - 1), F.lit(1)), F.least(at, F.lit(AROUND))), F.slice("words", at + 2, F.lit(AROUND))
    each = each.select("row", "word_at", "word", values.alias("values"), before.alias("before"), after.alias("after"))
    # outer: else the optimiser asks for the size of `values` in a filter for every word, which compiled code cannot hold, and
    # each word would then be copied with all words of its text
    each = each.select("row", "word_at", F.explode_outer("values").alias("value"), "word", F.lower(F.array_join("before", " ")).alias("before"), F.lower(F.array_join("after", " ")).alias("after"))
    return each.filter("value is not null")


def with_features(found: DataFrame, words: list[str], pairs: list[str]) -> DataFrame:
    """Add the FEATURES columns to candidates; words and pairs are of letters, without commas."""
    value, low, n = F.col("value"), F.lower("value"), F.length("value")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    flag = lambda c: c.cast("double")
    is_like = lambda pattern, of=value: flag(of.rlike(pattern))
    near = F.concat_ws(" ", "before", F.expr("lower(substring_index(word, value, 1))"))
    pieces = F.split(F.lower(F.regexp_replace(value, "([a-z])([A-Z])", "$1 $2")), "[^a-z]+")
    # a list in one string: as a value each, thousands of words make plans that fill the driver
    within = lambda x, own: F.find_in_set(x, F.lit(",".join(own))) > 0
    covered = F.aggregate(F.filter(pieces, lambda p: within(p, words)), F.lit(0), lambda s, p: s + F.length(p)) if words else F.lit(0)
    usual: Column = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: within(F.substr(low, i, F.lit(2)), pairs))) if pairs else F.lit(0)
    return found.withColumns({
        "length": n.cast("double"), "digits": share("[0-9]"), "upper": share("[A-Z]"), "symbols": share("[^A-Za-z0-9]"), "hexadecimal": is_like("^(?:[0-9a-f]+|[0-9A-F]+)$"), "only_digits": is_like("^[0-9]+$"),
        "changes": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"), "case_changes": share("(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "usual_pairs": usual / F.greatest(n - 1, F.lit(1)), "distinct": F.size(F.array_distinct(F.split(value, ""))) / n, "vowels": share("(?i)[aeiou]"), "covered": covered / n,
        "fragments": 1 - F.length(F.regexp_replace(low, "|".join(FRAGMENTS), "")) / n, "path": share("[/\\\\]"), "address": is_like("://|@[a-z]|\\.[a-z]{2,4}(?:[/\"',]|$)", F.lower("word")),
        "template": is_like("^[<$%{\\[]|\\$\\{|\\{\\{|\\*{3}|[xX]{4}|\\.{3}", F.expr("concat(substring_index(word, value, -1), value)")), "reference": is_like("[(\\[]|^[A-Za-z_]+(?:\\.[A-Za-z_]+)+$|::|->"),
        "dated": is_like("(?:19|20)[0-9]{2}-[01][0-9]|[0-9]{2}:[0-9]{2}"), "dashes": share("[-_]"), "known": is_like("^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_[A-Za-z0-9]{30,}|^github_pat_[A-Za-z0-9_]{22,}|^glpat-[A-Za-z0-9_-]{20}|^npm_[A-Za-z0-9]{36}|^xox[abp]-|^sk_live_|^AIza[A-Za-z0-9_-]{35}|^eyJ"),
        "header": is_like("(?i)data:[a-z]+/|base64,|isbn|version|^v[0-9]", F.concat_ws(" ", "before", "word")), "key_word": is_like(f"{_KEY}(?:[^\\p{{L}}]*(?:{_IS})?[^\\p{{L}}]*|{_OF}\\s*=[^\\p{{L}}]*)$", near),
        "other_word": is_like(f"(?:^|[^a-z])(?:{'|'.join(OTHERS)})[^a-z]*$", near), "assigned": is_like("[=:]>?[\"'`( ]*$", near), "quoted": is_like("[\"'`]", F.col("word")),
        "in_url": flag(F.regexp_extract("word", URL, 1) == value), "groups": share("(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])") * n,
    })


def _random(r: random.Random, alphabet: str, n: int) -> str:
    return "".join(r.choice(alphabet) for _ in range(n))


def _lines(words: list[str], n: int, seed: int) -> Iterator[tuple[str, str | None]]:
    """n lines with a secret and n without: (text, secret).  Every form occurs; values, keys and words around are drawn."""
    r = random.Random(seed)
    words = words or ["alpha", "beta", "gamma", "delta"]
    w = lambda k=1, glue=" ": glue.join(r.choice(words) for _ in range(k))
    letters, alnum, lower_hex = string.ascii_letters, string.ascii_letters + string.digits, "0123456789abcdef"
    hexa, plain, mixed, digits = (lambda n, a=a: _random(r, a, n) for a in (lower_hex, alnum, alnum + "+/_-", string.digits))
    blend = lambda: (w()[:4] + w()[-4:]).lower()  # noqa: E731  sounds like a word
    uuid = lambda: "-".join(hexa(k) for k in (8, 4, 4, 4, 12))
    secret_values = [
        lambda: hexa(r.choice([16, 20, 24, 32, 40, 64])), lambda: plain(r.randrange(12, 45)), lambda: mixed(r.randrange(16, 60)), lambda: mixed(40) + "==", lambda: digits(r.randrange(16, 30)), lambda: _random(r, letters, r.randrange(8, 24)),
        lambda: _random(r, alnum + "!@#$%^&*", r.randrange(8, 16)), lambda: w().title() + digits(r.randrange(2, 5)) + r.choice("!?#$%&*") + r.choice(["", w().title()]), lambda: r.choice("!@$%") + w() + r.choice("@!$") + digits(2) + _random(r, letters, 3), lambda: hexa(16).upper(),
        lambda: _random(r, alnum, r.randrange(5, 11)), lambda: _random(r, string.ascii_lowercase, 2) + digits(r.randrange(2, 5)) + _random(r, letters, r.randrange(3)), lambda: digits(r.randrange(4, 9)), lambda: _random(r, string.ascii_lowercase, r.randrange(9, 20)),
    ]
    keyed = ['{k} = "{v}"', "{k}={v}", "{k}: {v}", "'{k}': '{v}',", '"{k}": "{v}"', "export {K}={v}", "--{k}={v}", "the {k} is {v}", "{K}='{v}'", "{k} => '{v}'", "db_{k} = {v}", "{k}:{v}", "<{k}>={v};", "{k} : {v}", "{k} est {v}", "{k} ist {v}", "{k} of {u} = {v}", "{k} for the {u} = '{v}'"]
    urls = ["{s}://{u}:{v}@{h}.com/{d}", "{s}://{u}:{v}@{h}:5432", '"{s}://{u}:{v}@{h}.net/{d}?x=1"', "URL={s}://{u}:{v}@10.0.0.{d}"]
    bare = [lambda: "AKIA" + _random(r, string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + plain(36), lambda: f"github_pat_{plain(22)}_{plain(59)}", lambda: "glpat-" + plain(20), lambda: "AIza" + mixed(35).replace("/", "_").replace("+", "-"), lambda: f"xoxb-{digits(11)}-{plain(24)}", lambda: "sk_live_" + plain(24), lambda: "eyJ" + plain(40)]
    every, schemes = KEYS + SHORT_KEYS, "postgres mysql mongodb+srv redis amqp https ftp".split()
    decoys = [
        lambda: f"{r.choice(OTHERS)} {hexa(r.choice([32, 40, 64]))}", lambda: f"{r.choice(OTHERS)}: {hexa(r.choice([32, 40, 64]))}", lambda: f'{r.choice(OTHERS)}="{hexa(40)}"', lambda: f"{r.choice(OTHERS)} {uuid()}", lambda: f"{r.choice(OTHERS)}={uuid()}", lambda: f"{w()} {uuid()} {w()}",
        lambda: f"/usr/lib/x86_64/{w()}_{digits(2)}/{w()}.so", lambda: f"src/main/{w()}{digits(2)}/{w().title()}{w().title()}.java", lambda: f"https://{w()}.com/{w()}/{w(3, '-')}-{digits(6)}", lambda: f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
        lambda: f"version v{digits(1)}.{digits(2)}.{digits(1)}-rc{digits(1)}+build{digits(4)}", lambda: f"v{digits(1)}-{w()}-{digits(4)}-{hexa(7)}", lambda: f"data:image/png;base64,iVBORw0KGgo{mixed(60)}", lambda: f"at 20{digits(2)}-05-17T{digits(2)}:11:12Z {w()}", lambda: f"20{digits(2)}-05-{digits(2)}T{digits(2)}-log",
        lambda: f"IBAN DE{digits(20)}", lambda: f"order A{digits(12)}", lambda: f"SKU-{digits(5)}-{hexa(2).upper()}-{digits(4)}", lambda: f"{w(4, '_')}_{digits(3)}", lambda: f"{w(3, '-')}-{digits(2)}", lambda: "".join(w().title() for _ in range(3)) + digits(1), lambda: f"{w()}_{w()}_{digits(3)}@mail.{w()}.com",
        lambda: f"{r.choice(every)} = changeme{digits(3)}", lambda: f"{r.choice(every)}: your_{w()}_key_here", lambda: f"{r.choice(every)}=<your-{w()}-token>", lambda: f'{r.choice(every)} = "${{{w().upper()}_SECRET}}"', lambda: f"{r.choice(every)}: ********", lambda: f"{r.choice(every)} = xxxxxxxxxxxx", lambda: f"{r.choice(every)}=EXAMPLEKEY{digits(8)}",
        lambda: f'{r.choice(every)} = os.environ["{w().upper()}"]', lambda: f"{r.choice(every)} = get{w().title()}()", lambda: f"{r.choice(every)}: self.{w()}.{w()}", lambda: f"{r.choice(every)}: {w(2)}", lambda: f"the {r.choice(every)} is {w(2)}", lambda: f"{r.choice(every)} = {w()}", lambda: f"{r.choice(every)}: {w().title()}, {w()}", lambda: f"{r.choice(every)}={w(2, '_')}",
        lambda: f"{r.choice(['ISIN', 'isin:', 'security', w()])} {_random(r, string.ascii_uppercase, 2)}{digits(9)}{digits(1)}", lambda: f"{w()} {_random(r, string.ascii_uppercase, 2)}{_random(r, string.ascii_uppercase + string.digits, 9)}{digits(1)} {w()}",
        lambda: f"{w()} {r.choice(['code', 'device', 'part', 'serial', 'model', 'mac', w()])} {''.join(_random(r, 'ABCDEF', 1) + digits(1) for _ in range(r.randrange(6, 9)))}", lambda: f"{r.choice(['mac', 'device', w()])} {hexa(12).upper()}", lambda: f"{w()} 1Z{_random(r, string.ascii_uppercase + string.digits, 16)}", lambda: f"tracking {r.choice(['no', 'number', 'id'])} {_random(r, string.ascii_uppercase, 2)}{digits(9)}{_random(r, string.ascii_uppercase, 2)}",
        lambda: f"{w()} {_random(r, string.ascii_uppercase, 4)}{_random(r, string.ascii_uppercase + string.digits, 9)}", lambda: f"https://{w()}.com:8080/{w()}@{w()}", lambda: f"http://{w()}:80/{w()}{digits(3)}", lambda: f"{r.choice(every)}: {w()[: r.randrange(1, 6)]}", lambda: f"{r.choice(every)} : {w()}", lambda: f"le {r.choice(every)} est {w()}", lambda: f"{r.choice(every)} of {w()} = {w()}", lambda: f"the {r.choice(every)} is {blend()}", lambda: f"the {r.choice(every)} {r.choice(['is', 'is always', ':'])} {blend()}, {w()}", lambda: f"{r.choice(every)}: {blend()}", lambda: f"the {r.choice(every)} {w()} {w()} = {digits(2)}", lambda: f"{r.choice(every)}: {digits(1)}.", lambda: f"{r.choice(every)}=<{w()}>", lambda: f"{r.choice(['https', 'ftp'])}://user:password@{w()}.com", lambda: f"{r.choice(['https', 'redis'])}://{w()}:${{{w().upper()}_PASS}}@{w()}.com",
        lambda: f"test_{r.choice(KEYS)}=dummy_{w()}_{digits(2)}", lambda: f"{r.choice(every)}: none", lambda: f"{w()} {digits(16)} {w()}", lambda: f"+1 ({digits(3)}) 555-{digits(4)} {w()}",
    ]
    for k in range(n):
        if k % 8 >= 6:
            v = r.choice(bare)()
            form = r.choice(["{v}", "{v}", "use {v} now", '"{v}"', "{k}={v}", "({v})"])
        elif k % 8 == 3:
            v = r.choice(secret_values)().replace("/", "_").replace("@", "!")
            form = r.choice(urls)
        else:
            v, form = secret_values[k % len(secret_values)](), keyed[k // len(secret_values) % len(keyed)]
        key = r.choice(every)
        yield f"{w(r.randrange(4))} {form.format(k=key, K=key.upper(), v=v, s=r.choice(schemes), u=w(), h=w(), d=r.randrange(99))} {w(r.randrange(4))}".strip(), v
        yield f"{w(r.randrange(4))} {decoys[k % len(decoys)]()} {w(r.randrange(4))}".strip(), None


def labelled_lines(spark: SparkSession, words: list[str], n: int = LINES, seed: int = 7) -> DataFrame:
    """Made-up labelled findings (text, secret): n lines with a secret, n without; `words` stand around them."""
    return spark.createDataFrame(list(_lines(words, n, seed)), "text string, secret string").repartition(2)


def labelled(lines: DataFrame) -> DataFrame:
    """The candidates of labelled lines (text, secret) with label: 1 where value and secret overlap; lines without text count for nothing."""
    (row,) = fresh(lines, "line")
    keyed = lines.withColumn(row, F.col("secret"))  # the secret goes along as the row's id
    found = candidates(keyed, row, "text")
    return found.withColumn("label", F.coalesce(F.contains(F.col("value"), F.col("row.id")) | F.contains(F.col("row.id"), F.col("value")), F.lit(False)).cast("double"))


def fit(lines: DataFrame, words: list[str], pairs: list[str]) -> Model:
    """A forest from labelled lines (text, secret or null)."""
    rows = with_features(labelled(lines), words, pairs).select(*FEATURES, "label")
    data = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(rows).select("features", "label")
    return Model(RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7).fit(data), words, pairs)


def train(docs: DataFrame, findings: DataFrame | None = None, text_col: str = "text") -> Model:
    """A model with the dictionary of docs, from findings (text, secret), or from labelled_lines() where there are none."""
    words, pairs = dictionary(docs, text_col)
    return fit(findings if findings is not None else labelled_lines(docs.sparkSession, words[:500]), words, pairs)


def judged(found: DataFrame, model: Model) -> DataFrame:
    """Candidates with score and is_secret."""
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_features(found, model.words, model.pairs))
    scored = model.forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.select(*found.columns, "score", (F.col("score") >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """Every candidate with its score: doc_id, word_at (its word's number from 0), value, score (0 to 1), is_secret.

    A null or empty text has no candidates, an empty table gives no rows.  Every row is scanned by itself: rows that share a
    doc_id or repeat one another each have their candidates, and a null doc_id is kept.
    """
    model = model or train(docs, findings, text_col)
    return judged(candidates(docs, id_col, text_col), model).select(F.col("row.id").alias("doc_id"), "word_at", "value", "score", "is_secret")


def redact(docs: DataFrame, model: Model | None = None, mark: str = "[SECRET]", id_col: str = "doc_id", text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """docs with each secret of a row replaced by `mark` wherever it stands in that row's text, those of fewer than LEAST characters
    behind a key or in a URL only; count_col, where there is one, follows.

    Rows are told apart by id and text, so the secrets of one row never touch another of the same doc_id or of none.  All rows
    and columns stay, rows that repeat one another included; null and empty texts are left as they are.
    """
    model = model or train(docs, text_col=text_col)
    secrets = judged(candidates(docs, id_col, text_col), model).filter("is_secret").groupBy("row").agg(F.collect_set("value").alias("values"))
    both, (values,) = by_row(docs, secrets, "left", id_col, text_col)
    longest = F.array_sort(values, lambda a, b: F.length(b) - F.length(a))
    said, by = named(values).isNotNull(), mark.replace("\\", "\\\\").replace("$", "\\$")
    short = lambda t, v: F.regexp_replace(t, F.concat(F.lit(LEADS + "\\Q"), F.replace(v, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E(?![\\p{L}\\p{N}])")), F.lit(f"$1{by}"))
    each = lambda t, v: F.when(F.length(v) < LEAST, short(t, v)).otherwise(F.replace(t, v, F.lit(mark)))
    text = F.when(said, F.aggregate(longest, named(text_col).cast("string"), each)).otherwise(named(text_col))
    out = both.withColumn(text_col, text)
    if count_col in docs.columns:
        out = out.withColumn(count_col, F.when(said, F.length(named(text_col)).cast(docs.schema[count_col].dataType)).otherwise(named(count_col)))
    return out.select(*map(named, docs.columns))
