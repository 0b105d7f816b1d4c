"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds (the base) are reported wherever they stand. Weak kinds (account names, key-like assignments, endpoints)
are reported only if their complementary parts stand in the same scope, the whole text or a line, with at most `reach`
characters between (so over line ends too, unless the scope is a line): an account needs a secret, a key an identifier, an endpoint both. Parts become intervals; an interval join on
(row, line, bucket of `reach` characters) finds the neighbours, so the number of pairs is bound by what fits into a
bucket and not by the text.

Positions are in code points, the end exclusive. Defined results: a null text is empty and has no spans; texts of any
length are read whole; repeated rows give equal rows; only the id and the text are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import common

def _either(words: str) -> str:
    """The pattern with each letter in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


# Kind, pattern, group that is measured, least length of it.
_WORDS = "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key")))
_SET = r"""["']?\x20*[:=]\x20*["']?"""
BASE = [
    ("assign", rf"""({_WORDS}){_SET}([A-Za-z0-9+/_.=-]+)""", 2, 8),
    # the same as AKIA[A-Z0-9]+ of 16 and [0-9a-f]+ of 32 characters or more: a run too short holds no longer one
    ("access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
]
_NAMES = "|".join(map(_either, ("user(?:_?name|_?id)?", "login", "account", "client_?id", "access_?key_?id")))
_KEYS = "|".join(map(_either, ("pwd", "passphrase", "credentials?", "private_?key", "(?:secret_?)?access_?key", "secret_?key", "auth")))
WEAK = [
    ("account", rf"""(?:{_NAMES}){_SET}([A-Za-z0-9_.@+-]+)""", 1, 3),
    ("key", rf"""(?:{_KEYS}){_SET}([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("endpoint", r"""https?://([A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9_./-]*)?)""", 1, 4),
]
ROLE = {"assign": "secret", "hex": "secret", "key": "secret", "access": "id", "account": "id", "endpoint": "endpoint"}
ORDER = {kind: i for i, (kind, *_) in enumerate([*BASE, *WEAK])}
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


_CHUNK = 128


def with_spans(rows: DataFrame, kinds: list[tuple[str, str, int, int]], out: str, text: str = "text") -> DataFrame:
    """rows with `out`, the spans of each kind's leftmost non-overlapping matches whose group is long enough, kind after kind.

    Split and extract see the same matches, so lengths add up to places: within chunks of matches first, then over the
    chunks, so no long array is built element by element. Each step is a column of its own, computed once a row.
    """
    t, kept = F.col(text), rows.columns
    empty = lambda kind: F.array().cast(kind)

    def lengths(pattern: str, group: int) -> Column:
        """Of each match: what stands between it and the one before, its length, the length of its group."""
        whole, part = (F.regexp_extract_all(t, F.lit(pattern), F.lit(g)) for g in (0, group))
        steps = F.transform(F.arrays_zip(F.split(t, pattern, -1), whole, part), lambda x: F.struct(F.length(x["0"]).alias("b"), F.length(x["1"]).alias("w"), F.length(x["2"]).alias("p")))
        return F.when(t.rlike(pattern), F.filter(steps, lambda x: x["w"].isNotNull())).otherwise(empty("array<struct<b:int,w:int,p:int>>"))

    def step(acc: Column, x: Column) -> Column:
        end = acc["at"] + x["b"] + x["w"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(end.alias("end"), x["w"].alias("w"), x["p"].alias("p")))).alias("out"))

    def chunks(lens: Column) -> Column:
        """(length, places within) of each chunk of matches."""
        zero = F.struct(F.lit(0).alias("at"), empty("array<struct<end:int,w:int,p:int>>").alias("out"))
        each = F.transform(F.sequence(F.lit(1), F.size(lens), F.lit(_CHUNK)), lambda i: F.aggregate(F.slice(lens, i, F.lit(_CHUNK)), zero, step))
        return F.when(F.size(lens) > 0, each).otherwise(empty("array<struct<at:int,out:array<struct<end:int,w:int,p:int>>>>"))

    def bases(parts: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), empty("array<int>").alias("out"))
        return F.aggregate(parts, zero, lambda acc, c: F.struct((acc["at"] + c["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def placed(k: int, kind: str, least: int) -> Column:
        every = F.flatten(F.zip_with(f"_c{k}", f"_b{k}", lambda c, b: F.transform(F.filter(c["out"], lambda x: x["p"] >= least), lambda x: F.struct((b + x["end"] - x["w"]).alias("start"), F.lit(ORDER[kind]).alias("rank"), (b + x["end"]).alias("end"), F.lit(kind).alias("kind")))))
        return every.cast(_SPAN)

    rows = rows.withColumns({f"_l{k}": lengths(p, g) for k, (_, p, g, _) in enumerate(kinds)})
    rows = rows.withColumns({f"_c{k}": chunks(F.col(f"_l{k}")) for k in range(len(kinds))})
    rows = rows.withColumns({f"_b{k}": bases(F.col(f"_c{k}")) for k in range(len(kinds))})
    return rows.select(*kept, F.concat(*(placed(k, kind, n) for k, (kind, _, _, n) in enumerate(kinds))).alias(out))


def linked(docs: DataFrame, reach: int, scope: str = "text") -> DataFrame:
    """(key, more): the weak spans that complementary parts support, for the rows of docs (id, text) that have any; the scope is "line" or "text"."""
    if scope not in ("line", "text"):
        raise ValueError(f"unknown scope {scope!r}")
    guard = "|".join(p for _, p, _, _ in WEAK)
    some = docs.where(F.col("text").rlike(guard)).dropDuplicates(["id", "text"])
    blocks = F.split("text", "\n") if scope == "line" else F.array("text")
    lines = some.select(common.row_key("id", "text").alias("key"), F.posexplode(blocks).alias("line", "block"))
    before = Window.partitionBy("key").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("base", F.coalesce(F.sum(F.length("block") + 1).over(before), F.lit(0)).cast("int"))
    # outer: explode infers a filter on the array's size, into which the optimizer copies all searches, twice a read
    spans = with_spans(lines, [*BASE, *WEAK], "every", "block").select("key", "line", "base", F.explode_outer("every").alias("s")).where("s is not null")
    parts = spans.select("key", "line", (F.col("s.start") + F.col("base")).alias("start"), (F.col("s.end") + F.col("base")).alias("end"), F.col("s.rank").alias("rank"), F.col("s.kind").alias("kind"))
    roles = F.create_map(*(F.lit(x) for pair in ROLE.items() for x in pair))
    parts = parts.withColumn("role", roles[F.col("kind")])
    strong = [k for k, *_ in BASE]
    weak = parts.where(~F.col("kind").isin(strong)).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("end") + reach) / reach))))
    # an interval stands in every bucket that it touches; the first bucket two of them share is what counts
    other = parts.where("role <> 'endpoint'").select("key", "line", F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("role").alias("r2"), F.explode(F.sequence(F.floor(F.col("start") / reach), F.floor(F.col("end") / reach))).alias("bucket")).distinct()
    near = weak.join(other, ["key", "line", "bucket"]).where((F.col("s2") <= F.col("end") + reach) & (F.col("e2") >= F.col("start") - reach))
    held = near.groupBy("key", "start", "end", "rank", "kind", "role").agg(F.max((F.col("r2") == "id").cast("int")).alias("id"), F.max((F.col("r2") == "secret").cast("int")).alias("secret"))
    kept = held.where("(role = 'id' and secret = 1) or (role = 'secret' and id = 1) or (role = 'endpoint' and id = 1 and secret = 1)")
    return kept.groupBy("key").agg(F.collect_list(F.struct("start", "rank", "end", "kind")).alias("more"))


def scan(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text", scope: str = "text") -> DataFrame:
    """(id, base, spans) of every row: arrays of (start, rank, end, kind), by start and then by kind in the order of BASE and WEAK."""
    slim = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    rows = with_spans(slim, BASE, "base").select("id", common.row_key("id", "text").alias("key"), F.array_sort("base").alias("base"))
    out = rows.join(linked(slim, reach, scope), "key", "left")
    return out.select(F.col("id").alias(id_col), "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN)))).alias("spans"))


def rendered(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _merged(rows: DataFrame) -> DataFrame:
    """rows with `merged`: the spans of `found` with those that overlap made one, as (start, end, before), `before` being the end of the one before."""
    shape = "array<struct<start:int,end:int>>"

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        fresh = F.concat(acc, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] < F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0))), longer).otherwise(fresh)

    # merged within chunks first, so that no long array is built element by element; then what two chunks share
    chunk = F.transform(F.sequence(F.lit(1), F.size("found"), F.lit(_CHUNK)), lambda i: F.aggregate(F.slice("found", i, F.lit(_CHUNK)), F.array().cast(shape), step))
    rows = rows.withColumn("_chunks", F.when(F.size("found") > 0, chunk).otherwise(F.array().cast(f"array<{shape}>")))
    ends = F.transform("_chunks", lambda c: F.array_max(F.transform(c, lambda x: x["end"])))
    rows = rows.withColumn("_ends", ends)
    # the farthest end of all chunks before; a chunk's spans below it are cut to what lies beyond
    far = F.transform("_chunks", lambda c, k: F.coalesce(F.array_max(F.slice("_ends", F.lit(1), k)), F.lit(0)))
    cut = F.zip_with("_chunks", far, lambda c, e: F.filter(F.transform(c, lambda x: F.struct(F.greatest(x["start"], e).alias("start"), x["end"].alias("end"), (x["start"] < e).alias("joined"))), lambda x: x["start"] < x["end"]))
    rows = rows.withColumn("_flat", F.flatten(cut))
    before = F.transform("_flat", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(i > 0, F.element_at("_flat", F.greatest(i, F.lit(1)))["end"]).otherwise(0).alias("before"), x["joined"].alias("joined")))
    return rows.withColumn("merged", before).drop("_chunks", "_ends", "_flat")


def redacted(docs: DataFrame, reach: int = 200, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", mark: str = "[secret]", scope: str = "text") -> DataFrame:
    """docs with the same columns and rows, each found span of the text replaced by `mark`, overlapping ones by one.

    The column `chars_col`, if there, gets the new length; a null text stays null.
    """
    slim = docs.select(F.col(id_col).alias("id"), common.text_of(text_col).alias("text"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = with_spans(rows, BASE, "base").select("row", common.row_key("id", "text").alias("key"), F.array_sort("base").alias("base")).join(linked(slim, reach, scope), "key", "left")
    found = F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPAN))))
    text = F.col("row").getField(text_col)
    rows = rows.select("row", found.alias("found"))
    rows = _merged(rows)
    # a span that goes on from the chunk before has its mark already
    pieces = F.transform("merged", lambda s: F.when(s["joined"], F.lit("")).otherwise(F.concat(F.substring(text, s["before"] + 1, s["start"] - s["before"]), F.lit(mark))))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at("merged", -1)["end"] + 1, F.length(text)))
    rows = rows.select("row", F.when(F.size("merged") > 0, clean).otherwise(text).alias("clean"))
    new = {text_col: F.col("clean")} | ({chars_col: F.length("clean").cast(dict(docs.dtypes)[chars_col])} if chars_col in docs.columns else {})
    return rows.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))
