"""Secret scan: patterns find candidates, a random forest removes the false positives. JVM-side throughout.

Candidates of a text are private key blocks, quoted values after = or :, unquoted values after a credential
word and = or :, and runs of token characters with a digit; the name before = is no part of a value. Features: length, character transitions, alphabet use, dictionary coverage, the words before
and after, and the path. The forest (Spark ML) is trained from labelled findings and compiled into one
column expression, so that a document is scanned, judged and redacted in its own row: no join, no shuffle,
however many candidates a document or a source has.

The dictionary is what the corpus itself writes: its DICTIONARY most frequent words, counted over all rows;
the common letter pairs are those of that dictionary.

Labelled findings: a table (candidate, before, after, path, label), or by default labelled_findings():
FINDINGS lines around snippets of a bounded sample of SNIPPETS documents. Half of them get a secret of a
common kind where a credential stands, half get an identifier, checksum, address, version, placeholder or
words of the dictionary, also after the same credential words. Candidates are cut out of these lines by
the pattern that scans.

Defined cases: null texts have no findings and stay null; empty texts have none; repeated rows and equal
candidates are judged alike; texts of any length are scanned whole; an empty table gives an empty result;
the input may have columns of any names, which come back as they were.
"""

from __future__ import annotations

import itertools
from collections import Counter
from typing import NamedTuple

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.common import cut

#: Words that go with credentials, words that go with harmless tokens, words of placeholders.
CREDENTIAL = r"(?i)(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|client[_ -]?secret|auth(?:orization)?|bearer|credentials?)"
#: A block runs to its END line, header lines included; possessive loops take texts of any length without recursion.
CANDIDATE = (
    r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]++|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
    r"|(?<=[=:] ?[\"'])[^\s\"']{4,}+(?=[\"'])"
    r"|(?<=[=:>][ \t]{0,3})(?<![=:>\"'] ?[\"'])(?<=(?:" + CREDENTIAL + r")[A-Za-z0-9_-]{0,16}[\"']?[ \t]{0,3}(?::=|=>|[=:])[ \t]{0,3})(?!(?i:bearer|basic)\b)[^\s\"'=:>][^\s\"'<>]{2,}[^\s\"'<>.,;:)\]}]={0,2}+"
    r"|(?<![A-Za-z0-9_+/.~-])(?=[A-Za-z_+/.~-]*+[0-9])[A-Za-z0-9_+/.~-]{16,}+={0,2}+"
)
HARMLESS = r"(?i)(?:commit|sha-?\d+|md5|checksum|digest|hash|etag|revision|uuid|guid|request|trace|span|version|build|href|src|url|path|file|page|index|phone|date|time|ip|address)"
PLACEHOLDER = r"(?i)(?:example|sample|placeholder|changeme|change_me|dummy|redacted|your[_-]|xxxx|\*{4}|<[^>]+>|\$\{|0{8}|1234567|abcdef|test)"
KNOWN = r"^(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[_-](?:live|test|proj)?|AIza|eyJ[A-Za-z0-9_-]+\.|-----BEGIN )"
MARK = "[SECRET]"
BEFORE, AFTER = 48, 24
DICTIONARY, PAIRS = 3000, 120
FINDINGS, SNIPPETS = 6000, 120
FEATURES = ("length", "transitions", "case_changes", "digit_share", "upper_share", "symbol_share", "distinct_share", "dictionary", "common_pairs", "vowel_runs", "repeats", "hex_only", "dotted", "known", "placeholder", "assigned", "quoted", "credential_before", "harmless_before", "word_after", "test_path")


class Vocabulary(NamedTuple):
    """The corpus' frequent words, and patterns of them and of their common letter pairs."""

    words: list[str]
    word_pattern: str
    pair_pattern: str


def _alternatives(words: list[str]) -> str:
    """A pattern for any of the words, the longest first, branching by letter for two letters."""

    def branch(rest: list[str], depth: int) -> str:
        if depth == 2:
            return "|".join(sorted(rest, key=lambda w: (-len(w), w)))
        return "|".join(f"{first}(?:{branch([w[1:] for w in own], depth + 1)})" for first, own in itertools.groupby(sorted(rest), lambda w: w[0]))

    return f"(?:{branch(words, 0)})" if words else "(?!)"


def vocabulary(df: DataFrame, text_col: str = "text", size: int = DICTIONARY) -> Vocabulary:
    """Counts the words of all rows; only the most frequent come to the driver."""
    word = F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+")).alias("word")
    frequent = df.select(word).groupBy("word").count().where(F.length("word").between(3, 16)).orderBy(F.desc("count"), "word").limit(size)
    words = [r["word"] for r in frequent.collect()]
    pairs = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    common = sorted(sorted(pairs, key=lambda p: (-pairs[p], p))[:PAIRS])
    return Vocabulary(words, f"(?iu){_alternatives(words)}", f"(?iu)(?={'|'.join(common) or '(?!)'})\\p{{L}}")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _features(c: Column, before: Column, after: Column, path: Column, known: Vocabulary) -> list[Column]:
    n = F.greatest(F.length(c), F.lit(1)).cast("double")
    share = lambda pattern: _count(c, pattern) / n
    flag = lambda text, pattern: F.when(F.coalesce(text, F.lit("")).rlike(pattern), 1.0).otherwise(0.0)
    covered = (n - F.length(F.regexp_replace(c, known.word_pattern, ""))) / n
    near = F.right(before, F.lit(24))
    values = [
        F.least(n, F.lit(200.0)),
        share(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        share(r"[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        share("[0-9]"),
        share("[A-Z]"),
        share("[^A-Za-z0-9]"),
        F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0)),
        covered,
        share(known.pair_pattern),
        share(r"(?i)[aeiou][bcdfghjklmnpqrstvwxyz]{1,3}[aeiou]"),
        share(r"(.)\1\1"),
        flag(c, "^(?:[0-9a-f]+|[0-9A-F]+)$"),
        share(r"[.]"),
        flag(c, KNOWN),
        flag(c, PLACEHOLDER),
        flag(before, r"(?:=|:=|=>|:)\s{0,3}[\"']?$"),
        flag(before, r"[\"']$"),
        flag(near, CREDENTIAL),
        flag(near, HARMLESS),
        flag(after, r"^[\"']?\s?[A-Za-z]"),
        flag(path, r"(?i)(?:test|example|fixture|sample|docs?/|mock)"),
    ]
    return [v.cast("double").alias(name) for v, name in zip(values, FEATURES, strict=True)]


def _with_candidates(df: DataFrame) -> DataFrame:
    """df with a column text gets list, between (the texts around the candidates) and seen: array of (candidate, before, after)."""
    out = df.withColumn("list", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)))
    out = out.withColumn("between", F.when(F.size("list") > 0, F.split("text", CANDIDATE)))
    between = F.col("between")
    return out.withColumn("seen", F.transform("list", lambda c, i: F.struct(c.alias("candidate"), F.right(F.get(between, i), F.lit(BEFORE)).alias("before"), F.left(F.get(between, i + 1), F.lit(AFTER)).alias("after"))))


def snippets(df: DataFrame, text_col: str = "text", count: int = SNIPPETS) -> list[str]:
    """Pieces of 60 characters from somewhere in so many texts, those with the smallest hashes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    place = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - 60, F.lit(1))).cast("int") + 1
    rows = df.select(F.xxhash64(text, F.lit("snippet")).alias("order"), F.regexp_replace(F.substring(text, place, F.lit(60)), r"\S*[0-9=:\"']\S*", "").alias("snippet")).distinct()
    return [r["snippet"] for r in rows.orderBy("order", "snippet").limit(count).collect()]


def labelled_findings(spark: SparkSession, known: Vocabulary, around: list[str], rows: int = FINDINGS) -> DataFrame:
    """(candidate, before, after, path, label), the same rows each time. The size is fixed; one partition keeps the forest the same."""
    i = F.col("id")
    digest = lambda salt, bits: F.sha2(F.concat(F.lit(salt), i.cast("string")).cast("binary"), bits)
    b64 = lambda salt, bits: F.regexp_replace(F.base64(F.unhex(digest(salt, bits))), r"[\r\n]", "")
    pick = lambda salt, values: F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(F.xxhash64(F.lit(salt), i), F.lit(len(values))).cast("int") + 1)
    cut_to = lambda text, least, spread: text.substr(F.lit(1), (F.pmod(F.xxhash64(F.lit("n"), i), F.lit(spread)) + least).cast("int"))
    filler = [*(f"{x} " for x in around), "\n", "", "see also "]
    some = known.words[:: max(1, len(known.words) // 100)] or ["word", "thing"]
    secret = [
        digest("a", 256).substr(1, 40), digest("b", 256), digest("c", 256).substr(1, 32), F.upper(digest("u", 256)).substr(1, 40), cut_to(b64("d", 256), 20, 24), b64("e", 512).substr(1, 64),
        F.concat(F.lit("AKIA"), F.upper(F.translate(b64("f", 256), "+/=abcdefghij", "XYZ0123456789")).substr(1, 16)), F.concat(F.lit("ghp_"), F.translate(b64("g", 256), "+/=", "abc").substr(1, 36)),
        F.concat(F.lit("sk_live_"), F.translate(b64("h", 256), "+/=", "abc").substr(1, 24)), F.concat(F.lit("eyJhbGciOiJIUzI1NiJ9."), F.translate(b64("i", 256), "+/=", "-_a"), F.lit("."), F.translate(b64("j", 256), "+/=", "-_a")),
        cut_to(F.translate(b64("k", 256), "+/=", "!#%"), 10, 8),
        F.concat(pick("s1", ["Sup3r", "hunter", "Winter", "dr4gon", "Pa55", "monkey", "S3cret", "letme1n"]), pick("s2", ["S3cret", "#", "", "_", "W0rd", "x"]), F.pmod(F.xxhash64(F.lit("s3"), i), F.lit(9999)).cast("string"), pick("s4", ["!", "", "$", "#", "?"])),
        F.concat(F.lit("-----BEGIN "), pick("r", ["RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-256-CBC,00\n\n", "PRIVATE KEY-----\n", "PGP PRIVATE KEY BLOCK-----\nVersion: 1\n\n"]), b64("r1", 512), b64("r2", 512), F.lit("\n-----END "), pick("r", ["RSA PRIVATE KEY-----", "PRIVATE KEY-----", "PGP PRIVATE KEY BLOCK-----"])),
        F.concat(pick("t1", some), F.pmod(F.xxhash64(F.lit("t2"), i), F.lit(97)).cast("string"), pick("t3", some), pick("s4", ["!", "", "$", "#", "?"])),
        F.concat(pick("t4", some), pick("t5", some), pick("t6", some)),
    ]
    uuid = F.concat_ws("-", digest("l", 256).substr(1, 8), digest("l", 256).substr(9, 4), digest("l", 256).substr(13, 4), digest("l", 256).substr(17, 4), digest("l", 256).substr(21, 12))
    word = F.concat(pick("w", some), pick("w1", some))
    number = F.pmod(F.xxhash64(F.lit("m"), i), F.lit(99999)).cast("string")
    harmless = [
        F.concat(word, pick("w2", ["ered", "ouen", "schte", "aleque"]), number), uuid, digest("o", 256).substr(1, 40), digest("p", 256), F.concat(F.lit("mail"), number, F.lit("."), word, F.lit(".example.com")), F.concat(F.lit("www."), word, F.lit(".example.com/en/"), number),
        F.concat(F.lit("2024-0"), (F.pmod(i, F.lit(9)) + 1).cast("string"), F.lit("-11T10:00:00.000")), F.concat(pick("q", ["your_token_here_", "changeme-changeme-", "example_secret_", "xxxxxxxxxxxxxxxx", "placeholder-value-"]), number), F.concat(F.lit("0000000000000000"), number),
        F.concat(F.lit("v1."), number, F.lit(".0-release+"), number), F.concat_ws("-", F.lit("section"), number, word), F.concat_ws("_", word, F.lit("id"), number),
        pick("p", ["required", "string", "undefined", "optional", "nothing", "changed", "process.env.TOKEN", "os.environ", "settings.value", "config.auth.value", "expired", "rotation", "internationally", "documentation", "verenschung", "missing", "invalid", "${TOKEN}", "getenv(NAME", "********", *some]),
    ]
    good = pick("x", ['token = "', 'password = "', 'secret: "', 'api_key="', "API_KEY=", "Authorization: Bearer ", 'TOKEN = "', "access_key: ", "client_secret = '", 'credentials = "', "passwd=", "password: ", "DB_PASSWORD=", "secret = ", "token: "])
    bad = pick("y", ["", " ", "(", "commit ", "sha256 ", "checksum: ", "id=", 'version="', "see ", 'href="', "request ", "at ", "digest "])
    # Placeholders stand where secrets do, so the context alone does not decide.
    kind = F.pmod(F.xxhash64(F.lit("kind"), i), F.lit(len(harmless))).cast("int")
    plain = pick("x3", ["access_key: ", "passwd=", "password: ", "secret = ", "secret: ", "token: ", "token=", "credentials: "])
    lead = F.when((kind == 7) | (kind == 8), good).when(kind == 12, plain).otherwise(bad)
    label = F.pmod(i, F.lit(2))
    value = F.when(label == 1, F.element_at(F.array(*secret), F.pmod(F.xxhash64(F.lit("s"), i), F.lit(len(secret))).cast("int") + 1)).otherwise(F.element_at(F.array(*harmless), kind + 1))
    quoted = pick("x2", ['password = "', "passwd='", 'passphrase: "', 'PASSWORD="', 'secret = "'])  # words are a secret where somebody quotes them as one
    words_only = (label == 1) & ~value.rlike("[^\\p{L}]")
    before = F.concat(pick("v", filler), F.when(value.startswith("-----BEGIN "), pick("v2", filler)).when(words_only, quoted).when(label == 1, good).otherwise(lead))
    after = F.concat(F.when(before.rlike("[\"']$"), F.right(before, F.lit(1))).otherwise(F.lit("")), pick("z", [" and ", "\n", "", ", ", " for the ", ". "]))
    path = pick("t", ["src0", "src7", "conf/app.yaml", "docs/readme.md", "test/fixture.py", "main.go"])
    lines = spark.range(0, rows, 1, 1).select(F.concat(before, value, after).alias("line"), value.alias("value"), path.alias("path"), label.alias("label"))
    lines = cut(lines, "secret-lines")  # a small table; the expressions above are too large to be repeated
    found = _with_candidates(lines.withColumnRenamed("line", "text")).select("value", "path", "label", F.explode("seen").alias("x"))
    secret_part = (F.col("label") == 1) & F.col("value").contains(F.rtrim(F.col("x.candidate"), F.lit(".,")))
    return cut(found.select("x.candidate", "x.before", "x.after", "path", secret_part.cast("double").alias("label")), "secret-findings")


def train(findings: DataFrame, known: Vocabulary, trees: int = 15, depth: int = 6):
    """A forest from labelled findings (candidate, before, after, path, label)."""
    table = findings.select(*_features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"), known), F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(cut(table, "secret-features"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(rows)


def forest_expression(model, name) -> Column:
    """The forest's probability of label 1 as a column; name: a function from a feature's name to its column."""

    def below(node) -> Column:
        if node.getClass().getSimpleName() == "LeafNode":
            stats = list(node.impurityStats().stats())
            return F.lit(float(stats[1] / max(sum(stats), 1e-12)))
        split = node.split()
        return F.when(name(FEATURES[split.featureIndex()]) <= split.threshold(), below(node.leftChild())).otherwise(below(node.rightChild()))

    trees = [below(tree.rootNode()) for tree in model._java_obj.trees()]
    total = trees[0]
    for tree in trees[1:]:
        total = total + tree
    return total / len(trees)


def judged(df: DataFrame, findings: DataFrame | None, text_col: str, path_col: str, cutoff: float) -> DataFrame:
    """in (a struct of df's columns), text, between (the texts around the candidates) and found: array of (candidate, before, after, score, secret)."""
    known = vocabulary(df, text_col)
    model = train(findings if findings is not None else labelled_findings(df.sparkSession, known, snippets(df, text_col)), known)
    path = F.col(f"`{path_col}`") if path_col in df.columns else F.lit("")
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("in"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), path.alias("path"))
    out = _with_candidates(rows)
    featured = F.transform("seen", lambda x: F.struct(x["candidate"].alias("candidate"), x["before"].alias("before"), x["after"].alias("after"), *_features(x["candidate"], x["before"], x["after"], F.col("path"), known)))
    out = out.withColumn("features", featured)
    scored = F.transform("features", lambda x: F.struct(x["candidate"].alias("candidate"), x["before"].alias("before"), x["after"].alias("after"), F.round(forest_expression(model, lambda n: x[n]), 6).alias("score")))
    out = out.withColumn("scored", scored)
    found = F.transform("scored", lambda x: F.struct(x["candidate"].alias("candidate"), x["before"].alias("before"), x["after"].alias("after"), x["score"].alias("score"), (x["score"] >= cutoff).alias("secret")))
    return out.select("in", "text", "between", found.alias("found"))


def scan(df: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", cutoff: float = 0.5) -> DataFrame:
    """One row a candidate: doc_id, ordinal, length, candidate_sha256, before, after, score, secret. Secrets are not shown."""
    narrow = df.select(*{c: F.col(f"`{c}`") for c in (id_col, text_col, path_col) if c in df.columns}.values())
    each = judged(narrow, findings, text_col, path_col, cutoff).select(F.col(f"in.`{id_col}`").alias("doc_id"), F.posexplode("found").alias("ordinal", "x"))
    return each.select("doc_id", "ordinal", F.length("x.candidate").alias("length"), F.sha2(F.col("x.candidate").cast("binary"), 256).alias("candidate_sha256"), "x.before", "x.after", "x.score", "x.secret")


def redact(df: DataFrame, findings: DataFrame | None = None, text_col: str = "text", path_col: str = "source", length_col: str | None = "n_chars", cutoff: float = 0.5) -> DataFrame:
    """df with each secret in the text replaced by MARK; the length column follows the text."""
    out = judged(df, findings, text_col, path_col, cutoff)
    found, between = F.col("found"), F.col("between")
    shown = F.transform(found, lambda x, i: F.concat(F.when(x["secret"], F.lit(MARK)).otherwise(x["candidate"]), F.get(between, i + 1)))
    any_secret = F.exists(found, lambda x: x["secret"])
    clean = F.when(any_secret, F.concat(F.get(between, F.lit(0)), F.array_join(shown, ""))).otherwise(F.col(f"in.`{text_col}`"))
    out = out.select("in", any_secret.alias("any_secret"), clean.alias("clean"))
    columns = []
    for c in df.columns:
        own = F.col(f"in.`{c}`")
        if c == text_col:
            own = F.col("clean")
        elif c == length_col:
            own = F.when(F.col("any_secret"), F.length("clean").cast(df.schema[c].dataType)).otherwise(own)
        columns.append(own.alias(c))
    return out.select(*columns)
