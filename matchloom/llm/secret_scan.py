"""Secret scans in DataFrame functions only (operator 2).

Rule spans: three patterns, leftmost and non-overlapping each (``RULES``).
Their places come from cutting the text at the matches: the lengths of the
gaps and of the matches in turn add up to code-point offsets.

Model spans: two character Markov chains, of random strings and of ordinary
identifiers, give every long token, or each long part of one that rule spans
leave, a log-likelihood ratio per character; those above ``RATIO`` are spans of
kind ``markov``. The
chains are trained from a labelled sample by grouped counts; their tables have
a row for each pair of the fixed alphabet's characters at most, so they go into
the plan as literals.

Defined results: a null text is the empty text (no spans); an empty table
gives no rows; repeated rows are kept; an empty training sample gives ratios
of 0 and so no model spans; a null doc_id stays null; extra columns are
ignored by ``digest`` and carried in ``rest`` by ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_column

#: Fixed patterns: kind, pattern, group that is measured, least code points of it.
RULES = (
    ("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal, so short ones can't hide long ones
)
KINDS = (*(k for k, *_ in RULES), "markov")
#: Tokens that the chains judge: whole runs of these characters, however long, or what rule spans leave of them, from ``LEAST`` on.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 16
TOKEN = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
#: Log-likelihood ratio per character (natural log) above which a token is random.
RATIO = 0.5
SPAN = "struct<start:int,end:int,rank:int,kind:string>"
#: Items of a block of a scan, and code points of a piece of text.
BLOCK, PIECE = 64, 512


def _possible(text: Column, kind: str, pattern: str) -> Column:
    """A cheap test that no text with a match fails."""
    if kind == "assign":
        low = F.lower(text)
        return low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")
    return text.contains("AKIA") if kind == "access" else text.rlike(pattern)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _scan(items: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """All outputs (arrays of ``kind``) of ``step`` over the items in turn: (state, item) -> (next state, outputs).

    Outputs are gathered block by block, so that growing arrays stay short: the work is linear in the items for any real text.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def one(acc: Column, item: Column) -> Column:
        after, out = step(acc["state"], item)
        return F.struct(after.alias("state"), F.concat(acc["out"], out).alias("out"))

    def block(acc: Column, own: Column) -> Column:
        inner = F.aggregate(own, F.struct(acc["state"].alias("state"), none.alias("out")), one)
        return _let(inner, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    start = F.struct(state.alias("state"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))

    def scan(own: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(own, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(own) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)

    return _let(items, scan)


def _pieces(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def _cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text given in pieces: reads those that it touches only."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((end - 1) / PIECE).cast("int")
    near = F.array_join(F.slice(pieces, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.substring(near, start - first * PIECE + 1, end - start)


def _spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Array of spans of one kind, by the lengths of gaps and matches."""
    expression = F.lit(pattern)
    found = F.regexp_extract_all(text, expression, F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    sizes = F.transform(found, F.char_length)
    measured = sizes if not group else F.transform(F.regexp_extract_all(text, expression, F.lit(group)), F.char_length)
    rank = KINDS.index(kind)
    none = F.expr(f"cast(array() as array<{SPAN}>)")

    def step(at: Column, item: Column) -> tuple[Column, Column]:
        start = at + item["gap"]
        end = start + item["size"]
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"))
        return end, F.when(item["measured"] >= least, F.array(span)).otherwise(none)

    items = F.arrays_zip(gaps.alias("gap"), sizes.alias("size"), measured.alias("measured"))  # the last gap has no match: its size is null
    items = F.filter(items, lambda x: x["size"].isNotNull())
    return F.when(_possible(text, kind, pattern), _scan(items, F.lit(0), step, SPAN)).otherwise(none)


def labelled_sample(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(token, random boolean): random strings over usual alphabets, and ordinary identifiers put together from words."""
    base = spark.range(n)
    digest = F.sha2(F.concat_ws("/", F.lit("sample"), F.col("id").cast("string")), 512)
    random = base.select(F.explode(F.array(
        F.translate(F.base64(F.unhex(F.substring(digest, 1, 48))), "=", ""),
        F.translate(F.base64(F.unhex(F.substring(digest, 49, 60))), "+/=", "_-"),
        F.substring(F.translate(F.base64(F.unhex(digest)), "+/=", ""), 5, 36),
        F.substring(F.translate(F.upper(F.base64(F.unhex(digest))), "+/=", ""), 3, 24),
    )).alias("token"), F.lit(True).alias("random"))
    words = F.array(*[F.lit(w) for w in _WORDS.split()])
    pick = lambda salt: F.element_at(words, (F.pmod(F.xxhash64(F.lit(salt), F.col("id")), F.lit(len(_WORDS.split()))) + 1).cast("int"))
    a, b, c, d = (pick(k) for k in range(4))
    number = F.pmod(F.xxhash64("id"), F.lit(3000)).cast("string")
    plain = base.select(F.explode(F.array(
        F.concat(a, b, c), F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c), F.initcap(d)), F.concat_ws("-", a, b, c, number),
        F.concat_ws("/", a, b, c, d), F.upper(F.concat_ws("_", a, b, c)), F.concat_ws("-", F.initcap(a), F.initcap(b), number), F.concat(a, b, c, d),
        F.repeat(F.substring(F.lit(ALPHABET), (F.col("id") % len(ALPHABET) + 1).cast("int"), F.lit(1)), F.lit(20)),  # rulers and fillers
    )).alias("token"), F.lit(False).alias("random"))
    return random.union(plain)


#: Words of the ordinary sample: usual English words and terms of programs, and some of other languages in Latin letters.
_WORDS = (
    "data table index value request response handler manager service config user account session network machine learning version number message string "
    "column filter window stream buffer thread process system memory storage object class method function interface element container document language "
    "people water house children school mountain garden kitchen weather morning yesterday question answer friend brother sister teacher student journey "
    "bridge castle flower window shadow summer winter spring thunder lightning history science music painting theatre library market kingdom government "
    "between through against without because although whenever everything nothing something beautiful different important possible necessary available "
    "running walking speaking thinking building writing reading jumping standing breathing happened wanted needed started finished decided remembered "
    "Strasse Freiheit Wirtschaft Entwicklung zwischen schreiben verstehen Geschichte Zeitung Schule Kinder machen fragen suchen gehen kommen "
    "maison jardin fleur voiture chemin lumiere heureux parler manger travail pouvoir toujours beaucoup quelque ancien nouveau "
    "tiempo ciudad trabajo siempre corazon camino hermano mujer hablar escribir ventana pueblo"
)


def train(sample: DataFrame, strength: float = 1.0) -> tuple[list[float], int]:
    """Log ratios of character pairs, random over ordinary: a flat table over (previous, next); previous 0 is the start."""
    k = len(ALPHABET) + 1
    token = F.col("token")
    places = F.when(F.char_length(token) > 0, F.sequence(F.lit(1), F.char_length(token))).otherwise(F.expr("cast(array() as array<int>)"))
    code = lambda at: F.when(at < 1, 0).otherwise(F.instr(F.lit(ALPHABET), F.substring(token, at, F.lit(1))))
    pairs = sample.where("token is not null and random is not null").select("random", F.explode(F.transform(places, lambda i: code(i - 1) * k + code(i))).alias("pair"))
    counts = {(r["random"], r["pair"]): r["count"] for r in pairs.groupBy("random", "pair").count().collect()}  # 2 k^2 rows at most
    if not counts:
        return [0.0] * (k * k), k
    import math

    rows = {label: [sum(counts.get((label, p * k + q), 0) for q in range(k)) for p in range(k)] for label in (True, False)}
    log = lambda label, p, q: math.log((counts.get((label, p * k + q), 0) + strength) / (rows[label][p] + strength * k))
    return [log(True, p, q) - log(False, p, q) for p in range(k) for q in range(k)], k


def _ratio(token: Column, table: list[float], k: int) -> Column:
    """Mean log ratio per character."""
    ratios = F.split(F.lit(" ".join(f"{x:.6f}" for x in table)), " ").cast("array<double>")  # folded to one literal
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    total = F.aggregate(codes, F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")),
                        lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.element_at(ratios, (acc["last"] * k + c + 1).cast("int"))).alias("sum")),
                        lambda acc: acc["sum"])
    return total / F.char_length(token)


def _left_over(token: Column, base: Column) -> Column:
    """The parts of a token, of ``LEAST`` code points on, that lie outside the ordered rule spans."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    close = F.struct(token["end"].alias("start"), token["end"].alias("end"), F.lit(0).alias("rank"), F.lit("").alias("kind"))

    def step(at: Column, b: Column) -> tuple[Column, Column]:
        part = F.struct(at.alias("start"), b["start"].alias("end"), token["rank"].alias("rank"), token["kind"].alias("kind"))
        return F.greatest(at, b["end"]), F.when(b["start"] - at >= LEAST, F.array(part)).otherwise(none)

    touching = F.filter(base, lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"]))
    return _let(touching, lambda near: F.when(F.size(near) == 0, F.array(token)).otherwise(_scan(F.concat(near, F.array(close)), token["start"], step, SPAN)))


def scan(docs: DataFrame, model: tuple[list[float], int] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, rest, base array<span>, spans array<span>): rule spans, and all spans in order of start and kind; rest: the other columns."""
    table, k = model or train(labelled_sample(docs.sparkSession))
    text = F.col("text")
    others = [F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)] or [F.lit(None).alias("none")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"), F.struct(*others).alias("rest"))
    for name, *rule in ((kind, kind, pattern, group, least) for kind, pattern, group, least in RULES):
        rows = rows.withColumn(name, _spans(text, *rule))
    rows = rows.withColumn("base", F.array_sort(F.concat(*[F.col(kind) for kind, *_ in RULES])))
    rows = rows.withColumn("tokens", _spans(text, "markov", TOKEN, 0, 0))
    rows = rows.withColumn("parts", F.flatten(F.transform("tokens", lambda t: _left_over(t, F.col("base")))))
    random = lambda t: _ratio(_cut(F.col("pieces"), t["start"], t["end"]), table, k) > RATIO
    none = F.expr("cast(array() as array<string>)")
    rows = rows.withColumn("pieces", F.when(F.size("parts") > 0, _pieces(text)).otherwise(none)).withColumn("markov", F.filter("parts", random))
    return rows.select("doc_id", "text", "rest", "assign", "access", "hex", "base", F.array_sort(F.concat("base", "markov")).alias("spans"))


def span_list(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of rule spans, and all spans as text."""
    counts = [F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in RULES]
    return found.select("doc_id", *counts, F.sha2(span_list("base"), 256).alias("base_sha256"), span_list("spans").alias("spans"))


def masked(found: DataFrame, mask: str = "[secret]") -> DataFrame:
    """(doc_id, text, rest) with every span, overlapping ones merged, replaced by ``mask``."""
    pieces = F.col("pieces")
    none = F.expr("cast(array() as array<string>)")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        shown = F.when(s["kind"] == "", F.array(_cut(pieces, at, s["start"]))).when(s["start"] < at, none).otherwise(F.array(_cut(pieces, at, s["start"]), F.lit(mask)))
        return F.greatest(at, s["end"]), shown

    length = F.char_length("text")
    close = F.struct(length.alias("start"), length.alias("end"), F.lit(0).alias("rank"), F.lit("").alias("kind"))  # what is left after the last span
    out = F.array_join(_scan(F.concat("spans", F.array(close)), F.lit(0), step, "string"), "")
    rows = found.withColumn("pieces", F.when(F.size("spans") > 0, _pieces(F.col("text"))).otherwise(none))
    return rows.select("doc_id", F.when(F.size("spans") > 0, out).otherwise(F.col("text")).alias("text"), "rest")
