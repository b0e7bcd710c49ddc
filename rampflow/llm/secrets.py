"""Secret scan: candidates by pattern, false positives removed by a random forest. Native: expressions only.

Candidates are runs of key-like characters with a digit, and whatever follows a secret-like name and
an assignment, of any length and any characters. Their figures (length, character transitions,
dictionary coverage, path, neighbouring words) are column expressions, the same ones for labelled
findings and for documents. A forest is grown on the driver from the figures of the labelled
findings, a bounded table, and becomes a CASE expression per tree.
"""

from __future__ import annotations

import json
import random
import string

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged

#: A run of key characters with at least one digit, or a key id, starting where no such run goes on.
CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?:A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|[A-Za-z+/_\-]*+[0-9][A-Za-z0-9+/_\-]*+={0,2})"
SHORTEST = 12
#: Characters of the text on either side in which neighbouring words are looked for.
NEAR = 48

# Words that ordinary identifiers, paths and placeholders are made of.
DICTIONARY = (
    "access account address admin agent array asset author backup badge banner base block board body border button cache "
    "call change channel chapter check class client code color comment common config connect content control copy count "
    "country create custom data date debug default demo device dummy edit email entry error event example export false "
    "feature field figure file filter final first folder font format frame function gallery global grid group handler header "
    "height home host icon image import index info input insert item label last layer layout left level library light line "
    "link list load local login main manager master media menu message method model module move name network node number "
    "object offset open option order output page panel part path photo placeholder player point post print product profile "
    "project public query read record release remote report request reset result right root route sample schema screen script "
    "search section select sequence server service session sheet simple site size slide source start state static status step "
    "store stream string style switch system table target task template test text theme time title token track tree true type "
    "update upload user value version video view window word your"
).split()

# Leading characters of well-known key formats, and names that go before a secret or before a harmless value.
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk-|sk_live_|AIza|eyJ|SG|npm_|hf_)"
NAMES = r"passw|passphrase|pwd|secret|token|api[_\- ]?key|access[_\- ]?key|auth|bearer|credential|private"
NAMES_SECRET = rf"(?i)({NAMES})"
NAMES_HARMLESS = r"(?i)(sha-?\d|md5|hash|digest|checksum|commit|revision|uuid|guid|\bid\b|isbn|issn|doi|phone|card|order|invoice|version|build|example|sample|dummy|placeholder|tracking|serial)"
PATH_HARMLESS = r"(?i)(test|example|sample|fixture|mock|demo|doc)"

# A secret-like name with what may go on or close it and its assignment; the place after an assignment; another "name =".
_NAMED = rf"(?i:{NAMES.replace('auth', 'auth(?!or(?!i))')})[A-Za-z0-9_.\-]{{0,32}}[\"'`\]\\]{{0,3}}[ \t]{{0,16}}[=:]"
_ASSIGNED = r"(?<=[=:>\s\"'`])(?:(?<=[=:>])|(?<=[=:>\s][\"'`])|(?<=[=:>\s]\\[\"'`])|(?<=[=:>][ \t]{1,16}))"
_NEXT = r"[&;,|]+[\"']?[A-Za-z_][A-Za-z0-9_.\-]{0,40}[\"']?[=:]"
#: What follows a secret-like name and = or :, of any length: in quotes up to the closing one or white space; else up to white
#: space or the next name, without closing punctuation. An expression of Java, which looks behind for bounded lengths.
NAMED = (
    rf"{_ASSIGNED}(?<={_NAMED}[=:>]{{0,2}}[ \t]{{0,16}}\\?[\"'`]?)(?![A-Za-z0-9_.\-]{{0,32}}{_NAMED})"
    r"(?:(?<=\")[^\s\"]+|(?<=')[^\s']+|(?<=`)[^\s`]+"
    rf"|(?<![\"'`])(?![=:>\\])(?!{_NEXT})[^\s\"'`](?:(?:(?!{_NEXT})\S)*(?<![.,;:)\]}}>\"'`]))?)"
)
# What stands for a secret elsewhere (code, references) or for none.
STANDS_IN = r"(?i)^(\$[{(].*|\$[A-Z_]+|<.*|\{\{.*|%[({A-Z_].*|[A-Z_.]+[(\[].*|(os|self|env|this|config|settings|process|request|args)\..*|\**|none|null|nil|true|false|undefined|string|str|changeme|redacted|required|optional|.*(xxxx|your|example|password|passwd|secret|token).*)$"

FIGURES = (
    "length",
    "transitions",
    "dictionary",
    "digits",
    "upper",
    "lower",
    "hex_only",
    "digits_only",
    "distinct",
    "known",
    "separators",
    "near_secret",
    "near_harmless",
    "assigned",
    "quoted",
    "path_harmless",
    "letters_left",
    "punctuation",
    "stands_in",
)


def figures(value: Column, left: Column, right: Column, path: Column) -> Column:
    """The figures of a candidate as ``array<double>``, in the order of FIGURES; null neighbours and paths count as empty."""
    left, right, path = (F.coalesce(c, F.lit("")) for c in (left, right, path))
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / n
    has = lambda text, pattern: F.when(text.rlike(pattern), 1.0).otherwise(0.0)
    words = "(?i)(" + "|".join(DICTIONARY) + ")"
    return F.array(
        n,
        share(r"(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"),
        (n - F.length(F.regexp_replace(value, words, ""))) / n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        has(value, "^([0-9a-f]+|[0-9A-F]+)$"),
        has(value, r"^[0-9\-/+]+$"),
        F.size(F.array_distinct(F.split(value, ""))) / n,
        has(value, KNOWN),
        share(r"[/_\-+]"),
        has(F.right(left, F.lit(24)), NAMES_SECRET),
        has(F.right(left, F.lit(24)), NAMES_HARMLESS),
        has(left, r"[=:]\s*[\"'`]?$"),
        has(left, r"[\"'`]$") * has(right, r"^[\"'`]"),
        has(path, PATH_HARMLESS),
        has(left, r"\p{L}\s$"),
        share(r"[^A-Za-z0-9/_\-+=]"),
        has(value, STANDS_IN),
    )


def neighbours(left: Column, right: Column) -> tuple[Column, Column]:
    """The NEAR characters on either side of a value, for labelled findings and for documents."""
    return F.right(F.coalesce(left, F.lit("")), F.lit(NEAR)), F.substring(F.coalesce(right, F.lit("")), 1, NEAR)


def _spans(between: Column, found: Column, wanted) -> Column:
    """Per match: value, gap to the match before, and the text around a match that is ``wanted``, whatever it is made of.

    The text is between[0] found[0] between[1] ... between[n]. A match has a character at least, so 2 * NEAR
    of these pieces hold NEAR characters; of a long piece only its ends can be near a match.
    """
    cut = lambda p: F.when(F.length(p) > 2 * NEAR, F.concat(F.substring(p, 1, NEAR), F.right(p, F.lit(NEAR)))).otherwise(p)
    pieces = F.flatten(F.transform(F.arrays_zip(between.alias("b"), found.alias("f")), lambda z: F.array(cut(z["b"]), cut(F.coalesce(z["f"], F.lit(""))))))
    own = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("f"))

    def span(z, i, all_pieces):
        at, some = 2 * i + 2, lambda start, n: F.array_join(F.slice(all_pieces, start, n), "")
        first = F.greatest(at - 2 * NEAR, F.lit(1))
        left, right = neighbours(some(first, at - first), some(at + 1, F.lit(2 * NEAR)))
        return F.struct(z["f"].alias("value"), F.length(z["b"]).alias("gap"), F.when(wanted(z["f"]), left).alias("left"), F.when(wanted(z["f"]), right).alias("right"))

    # One transform over one array: the pieces are made once a text, not once a match.
    return F.flatten(F.transform(F.array(pieces), lambda p: F.transform(own, lambda z, i: span(z, i, p))))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """(doc_id, start, value, left, right, path) for every candidate; start counts characters from 0."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.col(path_col).cast("string").alias("path"))
    long = lambda v: F.length(v) >= SHORTEST
    rows = rows.where(F.col("text").rlike(f"[A-Za-z0-9+/_\\-]{{{SHORTEST}}}") | F.col("text").rlike(NAMED))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).withColumn("values", F.regexp_extract_all("text", F.lit(NAMED), F.lit(0)))
    rows = rows.where(F.exists("found", long) | (F.size("values") > 0))
    rows = rows.withColumn("between", F.split("text", CANDIDATE, -1)).withColumn("names", F.split("text", NAMED, -1)).withColumn("row", F.monotonically_increasing_id())
    runs, named = _spans(F.col("between"), F.col("found"), long), _spans(F.col("names"), F.col("values"), lambda v: F.lit(True))
    rows = rows.select("doc_id", "path", "row", F.explode(F.array(F.struct(F.lit(0).alias("by"), runs.alias("spans")), F.struct(F.lit(1).alias("by"), named.alias("spans")))).alias("of"))
    rows = rows.select("doc_id", "path", "row", "of.by", F.posexplode("of.spans").alias("i", "one")).select("doc_id", "path", "row", "by", "i", "one.*").repartition("row")
    upto = Window.partitionBy("row", "by").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.col("gap") + F.length("value")).over(upto) - F.length("value")
    rows = rows.withColumn("start", start).where(long("value") | (F.col("by") == 1))
    # A run that is also what follows a name is one candidate.
    nth = F.row_number().over(Window.partitionBy("row", "start", "value").orderBy("by"))
    return rows.withColumn("nth", nth).where("nth = 1").select("doc_id", "start", "value", "left", "right", "path")


def labelled_findings(spark: SparkSession, each: int = 150, seed: int = 7) -> DataFrame:
    """(value, left, right, path, label): findings of the usual kinds, each drawn ``each`` times, label 1 for a secret."""
    r = random.Random(seed)
    draw = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    hexa, b64 = "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    alnum, upper = string.ascii_letters + string.digits, string.ascii_uppercase + "234567"
    word = lambda: r.choice(DICTIONARY)
    prose = lambda: draw(string.ascii_lowercase, r.randint(2, 9)) + r.choice((" ", " ", ", "))
    name = lambda: r.choice(("password", "token", "secret", "api_key", "apikey", "client_secret", "auth_token", "access_key", "passwd"))
    other = lambda: r.choice((draw(string.digits, r.randint(1, 6)), word() + draw(string.digits, 2), draw(hexa, 16)))
    around = lambda: "".join(prose() if r.random() < 0.85 else other() + " " for _ in range(r.randint(1, 12)))
    pseudo = lambda least, most: draw(string.ascii_lowercase, r.randint(least, most))
    called = lambda: prose() + name() + r.choice((" = ", "=", ": "))
    quoted = lambda: r.choice(((called(), " "), (called() + '"', '"'), (called() + "'", "'")))

    def leet() -> str:
        """Letters of a word with one to four digits among or after them."""
        a = list(pseudo(5, 9).title() if r.random() < 0.7 else pseudo(5, 9))
        for _ in range(r.randint(1, 3)):
            a[r.randrange(len(a))] = r.choice(string.digits)
        return "".join(a) + draw(string.digits, r.randint(0, 2))

    def marked() -> str:
        """A password with one to four marks."""
        a = list(draw(alnum, r.randint(6, 18)) if r.random() < 0.5 else leet() + draw(string.digits, r.randint(0, 4)))
        for _ in range(r.randint(1, 3)):
            a.insert(r.randint(1, len(a) - 1), r.choice("!@#$%^&*?.~+,;:()[]{}<>|"))
        return "".join(a) + r.choice(("", "!", "#"))

    paths = ("src3", "src/app/main.py", "deploy/prod.env", "notes.txt", "")
    odd = ("tests/test_login.py", "docs/example.md", "samples/demo.cfg", "fixtures/mock.json")
    make = {
        1: (
            lambda: ("AKIA" + draw(upper, 16), prose(), ""),
            lambda: ("AKIA" + draw(string.ascii_uppercase + string.digits, 16), r.choice(("aws_access_key_id = ", "key: ", prose())), ""),
            lambda: ("ghp_" + draw(alnum, 36), r.choice((name() + "=", prose())), ""),
            lambda: ("sk-" + draw(alnum, 48), r.choice((name() + ": ", prose())), ""),
            lambda: (draw(hexa, r.choice((16, 18, 20, 24, 32))), prose() + name() + r.choice(("=", ": ", " = ")), " "),
            lambda: (draw(hexa, r.choice((32, 40, 64))), prose() + name() + r.choice((' = "', '="', ': "')), '"'),
            lambda: (draw(alnum, r.randint(16, 44)), prose() + name() + r.choice((' = "', "=", ": ")), r.choice(('"', " "))),
            lambda: (leet(), called(), " "),
            lambda: (draw(string.digits * 2 + "abcdef", r.choice((16, 18, 20, 24, 32))), *quoted()),
            lambda: (leet(), *quoted()),
            lambda: (marked(), called(), " "),
            lambda: (marked(), *quoted()),
            lambda: ("".join(pseudo(3, 8).title() for _ in range(r.randint(2, 4))), *quoted()),
            lambda: (draw(string.ascii_letters, r.randint(10, 32)), *quoted()),
            lambda: (pseudo(13, 28), *quoted()),
            lambda: (draw(b64, 40), "aws_secret_access_key" + r.choice((" = ", "=")), ""),
        ),
        0: (
            lambda: (draw(hexa, r.choice((32, 40, 64))), r.choice(("commit ", "sha256:", "md5 ", "checksum: ", "revision ", "digest=", "hash = ")), " "),
            lambda: ("-".join(draw(hexa, n) for n in (8, 4, 4, 4, 12)), r.choice(("id: ", "uuid=", prose())), " "),
            lambda: (draw(string.digits, r.randint(12, 19)), r.choice(("card ", "phone ", "order ", prose())), " "),
            lambda: (draw(string.digits, 4) + "-" + draw(string.digits, 2) + "-" + draw(string.digits, 6), prose(), " "),
            lambda: (f"{word()}_{word()}_{r.randint(1, 9999)}", prose(), " "),
            lambda: (f"{word()}{word().title()}{word().title()}{r.randint(0, 99)}", r.choice((prose(), "id = ")), " "),
            lambda: (f"/{word()}/{word()}/{word()}{r.randint(0, 999)}", r.choice(("href=", prose())), " "),
            lambda: ("your_api_key_" + draw(string.digits, 3), name() + "=", ""),
            lambda: ("x" * r.randint(12, 24) + draw(string.digits, 2), name() + ' = "', '"'),
            lambda: ("example" + word() + draw(string.digits, 4), name() + "=", ""),
            lambda: (f"{word()}-{r.randint(1, 20)}-{r.randint(0, 20)}-{word()}", r.choice(("version ", prose())), " "),
            lambda: (r.choice((pseudo(2, 10), pseudo(2, 10).title(), pseudo(2, 10).upper())), called(), " "),
            lambda: (r.choice((word(), word().title(), f"{word()}_{word()}", f"{word()}{word().title()}", f"{word()}-{word()}.{word()}")), *quoted()),
            lambda: (draw(string.digits, r.randint(1, 6)), *quoted()),
            lambda: (r.choice((f"get_{word()}()", f"os.environ[{word()}]", f"self.{word()}", "${" + word().upper() + "}", f"<{word()}-{word()}>", f"config.{word()}.{word()}", f"{pseudo(4, 9)}({pseudo(2, 6)})")), *quoted()),
            lambda: (r.choice(("None", "null", "true", "false", "string", "changeme", "*" * r.randint(4, 12), "x" * r.randint(4, 12), "your_password", "your-token-here", "REDACTED", "undefined", "password")), *quoted()),
            lambda: (draw(string.ascii_lowercase, r.randint(9, 20)) + draw(string.digits, r.randint(1, 3)), prose(), " "),
        ),
    }
    rows = []
    for label, kinds in make.items():
        for kind in kinds:
            for _ in range(each):
                value, left, right = kind()
                left = around() + left
                right += around() if right else r.choice(("", " " + around()))
                path = r.choice(paths) if label or r.random() < 0.8 else r.choice(odd)
                rows.append({"value": value, "left": left, "right": right, "path": path, "label": label})
    kind = "array<struct<value string, left string, right string, path string, label int>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


class Forest:
    """Random forest of small trees: bootstrap rows, a random third of the figures at each node, Gini splits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, least: int = 3, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.width = x.shape[1]
        self.trees = [self._grow(x[i], y[i], depth, least, rng) for i in (rng.integers(0, len(x), len(x)) for _ in range(trees))]

    def _grow(self, x, y, depth, least, rng):
        mean = float(y.mean())
        if depth == 0 or mean in (0.0, 1.0) or len(y) < 2 * least:
            return mean
        best = (1e-12, None, None)
        whole = len(y) * mean * (1 - mean)
        for f in rng.permutation(self.width)[: max(1, -(-self.width // 3))]:
            order = np.argsort(x[:, f], kind="stable")
            v, t = x[order, f], y[order]
            n = np.arange(1, len(t))
            a = np.cumsum(t)[:-1]
            b, m = t.sum() - a, len(t) - n
            loss = a * (1 - a / n) + b * (1 - b / m)
            fine = (v[1:] > v[:-1]) & (n >= least) & (m >= least)
            if fine.any():
                k = int(np.where(fine, loss, np.inf).argmin())
                if whole - loss[k] > best[0]:
                    best = (whole - loss[k], int(f), float((v[k] + v[k + 1]) / 2))
        _, f, cut = best
        if f is None:
            return mean
        go = x[:, f] <= cut
        return f, cut, self._grow(x[go], y[go], depth - 1, least, rng), self._grow(x[~go], y[~go], depth - 1, least, rng)

    def predict(self, row: list[float]) -> float:
        def walk(t):
            while isinstance(t, tuple):
                t = t[2] if row[t[0]] <= t[1] else t[3]
            return t

        total = 0.0
        for t in self.trees:
            total += walk(t)
        return total / len(self.trees)

    def column(self, x: Column) -> Column:
        """The forest as an expression of an ``array<double>`` of figures."""

        def case(t) -> Column:
            return F.when(x[t[0]] <= t[1], case(t[2])).otherwise(case(t[3])) if isinstance(t, tuple) else F.lit(float(t))

        total = F.lit(0.0)
        for t in self.trees:
            total = total + case(t)
        return total / float(len(self.trees))


def train(findings: DataFrame, most: int = 50_000, **options) -> Forest:
    """Grow a forest from labelled findings; more than ``most`` of them are thinned by a hash of the finding."""
    findings = findings.where("label in (0, 1) and value is not null")
    every = max(1, -(-findings.count() // most))
    findings = findings.where(F.pmod(F.xxhash64("value", "left", "right", "path"), F.lit(every)) == 0)
    left, right = neighbours(F.col("left"), F.col("right"))
    rows = findings.select(figures(F.col("value"), left, right, F.col("path")).alias("x"), F.col("label")).collect()
    rows = sorted((r["x"], r["label"]) for r in rows)
    return Forest(np.array([x for x, _ in rows]), np.array([y for _, y in rows], float), **options)


def kind_of(value: Column, left: Column) -> Column:
    named = F.right(F.coalesce(left, F.lit("")), F.lit(24))
    return (
        F.when(value.rlike("^A[KS]IA[A-Z0-9]{16}$"), "access_key_id")
        .when(value.rlike(KNOWN), "service_key")
        .when(named.rlike("(?i)(passw|passphrase|pwd)"), "password")
        .when(named.rlike(NAMES_SECRET), "token")
        .otherwise("other")
    )


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Every candidate of every text with its verdict: doc_id, start, length, kind, value, score double, secret boolean.

    ``findings(value, left, right, path, label)`` teach the forest; by default the built-in ones. secret: score is
    at least ``threshold``. Null and empty texts have no candidates; a null path counts as empty. Repeated
    rows give their candidates again. An empty table gives no rows; other columns of ``docs`` are
    ignored, whatever their names. Equal candidates with equal neighbours have equal scores;
    texts of any length are scanned whole.
    """
    spark = docs.sparkSession
    forest = train(labelled_findings(spark) if findings is None else findings)
    found = candidates(docs, id_col, text_col, path_col)
    found = found.select("doc_id", "start", "value", kind_of(F.col("value"), F.col("left")).alias("kind"), figures(F.col("value"), F.col("left"), F.col("right"), F.col("path")).alias("x"))
    found = staged(found, "secret-candidates")
    scored = found.withColumn("score", forest.column(F.col("x")))
    return scored.select("doc_id", F.col("start").cast("long").alias("start"), F.length("value").alias("length"), "kind", "value", "score", (F.col("score") >= threshold).alias("secret"))
