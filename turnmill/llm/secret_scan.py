"""Secret scans: candidate strings by pattern, false positives removed by a random forest.

Candidates are key headers, values of 8 characters or more set after a secret
word, keys by their prefix, and strings of 16 or more with a digit.

Everything that runs on documents is a DataFrame function: candidates are cut
out by one pattern, their features are column expressions, and the trained
forest is a column expression, too.  Features are the candidate's length, the
transitions between its kinds of characters, how much of it common words cover,
path marks, and the words around it.

The forest is trained on labelled findings (before, candidate, after, label):
by default on ``labelled_findings``, which builds keys of usual formats and the
usual look-alikes (digests, ids, paths, placeholders, long words and numbers)
from a counter and md5.  Its features come from the same column expressions.

Not candidates are values with white space or quotes inside, and strings of fewer
than 16 characters or without a digit unless a secret word or a known prefix
stands before them.

Defined results: null and empty text has no findings.  A finding's start counts
characters from 1.  Repeated rows have findings of their own, and so has each
place where one string occurs; equal scores do not compete.  Header lines of
private keys always score 1.  Very long texts are scanned whole, by patterns
that do not recurse.  An empty table has no findings.  Columns of docs other than
id and text play no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# What a candidate looks like.  A value that is set after a secret word may hold any characters but
# white space and quotes; each lookbehind is of one width, and the short ones come first, as most places fail them.
NAMES = ["token", "secret", "secret_key", "secret-key", "password", "passwd", "passwort", "passphrase", "pwd", "apikey", "api_key", "api-key", "auth", "credential", "credentials", "private_key", "access_key", "access-key"]
SIGNS = ["=", ":", "= ", ": ", " = ", " : ", " := ", " => ", "=\"", "='", ":\"", ":'", "= \"", "= '", ": \"", ": '", " = \"", " = '", " : \"", " : '", " := \"", " => \"", " => '", "\":\"", "\": \"", "\" : \"", "':'", "': '", "': \"", "\":", "\": ", " \"", " '"]
_SET = "|".join(f"(?:(?<={sign})(?:" + "|".join(f"(?<={name}{sign})" for name in NAMES) + "))" for sign in SIGNS)
VALUE = rf"(?<=[=:\"' ])(?:(?<=[=:\"'])|(?<=[=:>] ))(?i:{_SET})[^\s\"']{{7,}}[^\s\"'.,;:!?)\]}}>]"
BEARER = r"(?<=[rR] )(?:(?<=[bB]earer )|(?<=BEARER ))[A-Za-z0-9._~+/\-]{8,}={0,2}"
PREFIXED = r"(?<![A-Za-z0-9+/_\-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{30,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[A-Za-z0-9_\-]{35}|glpat-[A-Za-z0-9_\-]{20,}|eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]*)"
LONG = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
CANDIDATE = "|".join([r"-----BEGIN [A-Z ]*PRIVATE KEY-----", VALUE, BEARER, PREFIXED, LONG])
BEFORE, AFTER = 48, 24
THRESHOLD = 0.5
TREES, DEPTH = 15, 5

# Words that speak for or against a secret, and words that make up identifiers.
SECRET_WORDS = ["token", "secret", "passw", "apikey", "api_key", "api-key", "auth", "bearer", "credential", "private", "access", "key"]
OTHER_WORDS = ["sha", "md5", "digest", "checksum", "commit", "hash", "uuid", "guid", "id", "version", "build", "etag", "integrity", "order", "number"]
EXAMPLE_WORDS = ["example", "sample", "dummy", "placeholder", "changeme", "your", "test", "xxxx", "1234567890", "abcdef"]
DICTIONARY = ["access", "account", "address", "after", "application", "array", "backup", "before", "buffer", "build", "business", "button", "cache", "chapter", "class", "client", "column", "command", "config", "connection", "container", "content", "control", "count", "create", "data", "date", "default", "delete", "detail", "document", "download", "element", "error", "event", "example", "field", "file", "filter", "folder", "form", "format", "function", "group", "handler", "header", "image", "index", "info", "input", "item", "label", "layout", "length", "level", "library", "list", "local", "manager", "message", "method", "model", "module", "name", "network", "node", "number", "object", "option", "order", "output", "package", "page", "panel", "parameter", "parent", "path", "point", "policy", "process", "product", "project", "property", "query", "record", "report", "request", "response", "result", "route", "schema", "screen", "script", "search", "section", "select", "server", "service", "session", "setting", "size", "source", "state", "status", "storage", "string", "style", "system", "table", "target", "task", "template", "test", "text", "time", "title", "type", "update", "upload", "user", "value", "version", "video", "view", "widget", "window"]


def _any(words: list[str]) -> str:
    return "|".join(words)


def _share(text: Column, pattern: str, of: Column) -> Column:
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / of


def feature_columns() -> dict[str, Column]:
    """Features of (before, candidate, after), as doubles."""
    c, low = F.col("candidate"), F.lower("candidate")
    near = F.lower(F.substring_index(F.trim(F.regexp_replace("before", r"[\s\"'=:>({]+", " ")), " ", -2))
    around = F.lower(F.concat_ws(" ", F.col("before"), F.col("after")))
    n = F.greatest(F.length(c), F.lit(1)).cast("double")

    def moves(a: str, b: str) -> Column:
        return F.size(F.regexp_extract_all(c, F.lit(f"(?=({a}{b}))[{a[1:-1]}]"), F.lit(0))) / n

    upper, lower, digit, mark = "[A-Z]", "[a-z]", "[0-9]", "[+/_=-]"
    alike = F.size(F.array_distinct(F.split(c, ""))) / F.least(n, F.lit(64.0))
    out = {
        "length": n,
        "upper": _share(c, upper, n),
        "lower": _share(c, lower, n),
        "digit": _share(c, digit, n),
        "mark": _share(c, mark, n),
        "lower_digit": moves(lower, digit),
        "digit_lower": moves(digit, lower),
        "upper_lower": moves(upper, lower),
        "lower_upper": moves(lower, upper),
        "distinct": alike,
        "hex": c.rlike("^[0-9a-f]+$|^[0-9A-F]+$").cast("double"),
        "dictionary": _share(low, _any(sorted(DICTIONARY, key=len, reverse=True)), n),
        "vowels": _share(low, "[aeiou]", n),
        "path": (c.rlike("/[A-Za-z_-]+/") | F.col("before").rlike(r"[/\\.]$") | F.col("after").rlike(r"^[/\\]|^\.[a-z]{2,4}\b")).cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "secret_word": near.rlike(_any(SECRET_WORDS)).cast("double"),
        "other_word": near.rlike(rf"\b(?:{_any(OTHER_WORDS)})").cast("double"),
        "example_word": (around.rlike(_any(EXAMPLE_WORDS[:7])) | low.rlike(_any(EXAMPLE_WORDS))).cast("double"),
        "uuid": c.rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$").cast("double"),
    }
    return {k: v.cast("double") for k, v in out.items()}


def labelled_findings(spark: SparkSession, count: int = 4000) -> DataFrame:
    """(before, candidate, after, label): built by rule from a counter, label 1 for secrets."""
    pick = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(n)).cast("int")
    one_of = lambda salt, words: F.get(F.array(*map(F.lit, words)), pick(salt, len(words)))
    digest = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 512)
    base64 = F.regexp_replace(F.base64(F.unhex(digest)), "[+/=]", "x")
    url_safe = F.translate(F.base64(F.unhex(digest)), "+/=", "-_z")
    letters = F.upper(F.translate(base64, "0123456789", "QWZXKVJPYB"))
    words = [F.initcap(one_of(f"w{k}", DICTIONARY)) for k in range(4)]
    assign = one_of("assign", [" = \"", "=", ": \"", ": ", "='", " := \"", " "])
    before_secret = F.concat(one_of("prose", ["", "the value ", "and then ", "export ", "set "]), one_of("key", ["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "Authorization: Bearer", "private_key", "credential"]), assign)
    before_other = F.concat(one_of("prose2", ["", "see ", "from ", "in the ", "at "]), one_of("other", ["sha256", "md5", "commit", "digest", "checksum", "uuid", "request id", "build", "etag", "version", "image", "file", "order number", "phone", "page", "and the", "with", "of"]), one_of("assign2", [" ", ": ", "=", " = \"", "/", " #"]))
    after = one_of("after", ["\"", "", " and more", "'", "\n", ", then", "\" the"])
    secret = F.element_at(
        F.array(
            F.substring(digest, 1, 40),
            F.expr("substring(sha2(concat('f ', id), 256), 1, 32)"),
            F.sha2(F.col("id").cast("string"), 256),
            F.concat(F.lit("AKIA"), F.upper(F.substring(F.regexp_replace(base64, "[a-z]", "7"), 1, 16))),
            F.concat(F.lit("ghp_"), F.substring(base64, 1, 36)),
            F.substring(base64, 1, 24),
            F.substring(url_safe, 1, 43),
            F.concat(F.lit("sk_live_"), F.substring(base64, 3, 24)),
            F.concat(F.lit("AKIA"), F.substring(letters, 1, 16)),
            F.concat(F.lit("eyJ"), F.substring(url_safe, 1, 17), F.lit("."), F.lit("eyJ"), F.substring(url_safe, 20, 30), F.lit("."), F.substring(url_safe, 8, 43)),
            F.concat(F.substring(base64, 5, 5), one_of("mark", ["!", "$", "#", "@", "%", "."]), F.substring(base64, 30, 4)),
            F.concat(F.substring(letters, 3, 3), F.lower(F.substring(letters, 9, 9)), one_of("mark2", ["!", "$", "", "&", "*"])),
        ),
        pick("format", 12) + 1,
    )
    camel = F.concat(F.lower(words[0]), words[1], words[2], pick("version", 99).cast("string"))
    other = F.element_at(
        F.array(
            F.substring(digest, 1, 40),
            F.md5(digest),
            F.sha2(digest, 256),
            F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.substring(digest, 13, 4), F.substring(digest, 17, 4), F.substring(digest, 21, 12)),
            camel,
            F.concat_ws("_", F.lower(words[0]), F.lower(words[1]), F.lower(words[2]), pick("version", 9).cast("string")),
            F.concat_ws("/", F.lower(words[0]), F.lower(words[1]), F.concat(F.lower(words[2]), pick("version", 9).cast("string"))),
            F.lpad(F.abs(F.xxhash64("id")).cast("string"), 16, "4"),
            F.concat(F.lower(words[0]), F.lower(words[1]), F.lower(words[2]), F.lower(words[3]), F.lit("2")),
        ),
        pick("format2", 9) + 1,
    )
    placeholder = F.element_at(F.array(F.lit("your-api-key-goes-here-1"), F.lit("xxxxxxxxxxxxxxxxxxxx1"), F.lit("1234567890abcdef1234567890abcdef"), F.concat(F.lit("example_"), F.substring(digest, 1, 20)), camel, F.concat(F.lower(words[0]), F.lit("."), F.lower(words[1]), F.lit("()")), F.concat(F.lit("<your-"), F.lower(words[0]), F.lit(">")), F.concat(F.lit("${"), F.upper(words[0]), F.lit("_"), F.upper(words[1]), F.lit("}")), F.concat(F.lower(words[0]), F.lower(words[1]))), pick("format3", 9) + 1)
    kind = pick("kind", 10)
    return (
        spark.range(count)
        .select(
            "id",
            F.when(kind < 5, before_secret).when(kind < 9, before_other).otherwise(before_secret).alias("before"),
            F.when(kind < 5, secret).when(kind < 9, other).otherwise(placeholder).alias("candidate"),
            after.alias("after"),
            (kind < 5).cast("int").alias("label"),
        )
        .orderBy("id")
        .select("before", "candidate", "after", "label")
    )


class Tree:
    """A binary tree of (feature, limit, left, right), or a share of label 1."""

    @staticmethod
    def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
        if depth == 0 or len(y) < 8 or y.min() == y.max():
            return float(y.mean())
        best = None
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5) + 2), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            at = np.flatnonzero(v[1:] > v[:-1])
            if len(at):
                left, total = at + 1.0, len(y)
                p, q = ones[at] / left, (ones[-1] - ones[at]) / (total - left)
                impurity = left * p * (1 - p) + (total - left) * q * (1 - q)
                k = int(impurity.argmin())
                if best is None or impurity[k] < best[0]:
                    best = (impurity[k], int(f), float((v[at[k]] + v[at[k] + 1]) / 2))
        if best is None:
            return float(y.mean())
        low = x[:, best[1]] <= best[2]
        return best[1], best[2], Tree.grow(x[low], y[low], rng, depth - 1), Tree.grow(x[~low], y[~low], rng, depth - 1)

    @staticmethod
    def column(tree, names: list[str]) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        f, limit, left, right = tree
        return F.when(F.col(names[f]) <= limit, Tree.column(left, names)).otherwise(Tree.column(right, names))


def train(findings: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 17) -> list:
    """A forest over rows (before, candidate, after, label); they are few and go to the driver."""
    names = feature_columns()
    rows = findings.select(*[v.alias(k) for k, v in names.items()], "label").collect()
    data = np.array(sorted(map(tuple, rows)), float)
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        part = rng.integers(0, len(data), len(data))
        forest.append(Tree.grow(data[part, :-1], data[part, -1], rng, depth))
    return forest


def candidates(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, finding_no, start, before, candidate, after) of all strings that look like secrets.

    A text is split at its candidates, so that the pieces between them give the
    places and surroundings.
    """
    some = docs.select(F.col(id_column).alias("_id"), F.col(text).alias("_text")).where(F.col("_text").rlike(CANDIDATE))
    cut = some.select("_id", F.monotonically_increasing_id().alias("_row"), F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split("_text", CANDIDATE, -1).alias("_between"))
    each = cut.select(
        "_id",
        "_row",
        F.posexplode(
            F.transform(
                "_found",
                lambda c, k: F.struct(
                    c.alias("candidate"),
                    # What stands around may be another candidate.
                    F.right(F.concat(F.coalesce(F.get("_found", k - 1), F.lit("")), F.get("_between", k)), F.lit(BEFORE)).alias("before"),
                    F.left(F.concat(F.get("_between", k + 1), F.coalesce(F.get("_found", k + 1), F.lit(""))), F.lit(AFTER)).alias("after"),
                    F.length(F.get("_between", k)).alias("skipped"),
                ),
            )
        ).alias("finding_no", "x"),
    )
    before = Window.partitionBy("_row").orderBy("finding_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("x.candidate")
    start = F.sum(F.col("x.skipped") + size).over(before) - size + 1
    return each.select(F.col("_id").alias(id_column), "finding_no", start.alias("start"), "x.before", "x.candidate", "x.after")


def scan_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text", forest: list | None = None) -> DataFrame:
    """(id, finding_no, start, length, candidate, score, is_secret) of all candidates of docs."""
    forest = train(labelled_findings(docs.sparkSession)) if forest is None else forest
    names = feature_columns()
    found = candidates(docs, id_column, text).select(id_column, "finding_no", "start", "candidate", *[v.alias(f"f_{k}") for k, v in names.items()])
    votes = F.lit(0.0)
    for tree in forest:
        votes = votes + Tree.column(tree, [f"f_{k}" for k in names])
    score = F.when(F.col("candidate").startswith("-----BEGIN"), F.lit(1.0)).otherwise(F.round(votes / len(forest), 9))
    scored = found.select(id_column, "finding_no", "start", F.length("candidate").alias("length"), "candidate", score.alias("score"))
    return scored.withColumn("is_secret", F.col("score") >= THRESHOLD)
