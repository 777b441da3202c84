"""Conversation repair: the cheapest edits that bring each conversation's roles into ``(s?(ua)+)?``.

One exchange, by conversation. Windows over it find the fault of each turn; the turns are collected, sorted, and one
native ``aggregate`` folds them. Its accumulator holds four (cost, audit) structs, one for what may stand last so far:
nothing (e), system (s), user (u), assistant (a). ``least`` over structs takes the cheaper one and, at a tie, the
smaller audit: audits of one place never open each other at equal cost, as letters alone say what they cost. Unreachable
ones are null, which ``least`` passes over.

A conversation of more than LONG_ROWS turns or LONG_BYTES bytes isn't collected. Its turns are sorted by range, parts of
at most PART_ROWS turns are folded from each of the four states, the parts' 4 x 4 tables are folded per conversation, and
each part is repaired by itself; only the digest, which is one chain by nature, passes one task, as a stream. Both ways
give the same rows.

Defined results: null roles and texts count as one space; a null conv_id is a conversation; null turns come first
and are no turn number; turns of one number are taken by role, then text; repeated rows are turns like any other (the later
one a duplicate); an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from outlay.llm.bytes_text import lean
from outlay.llm.workspace import materialise, slots

LONG_ROWS, LONG_BYTES = 1024, 1 << 26
#: Turns of a part of a long conversation: a power of two.
PART_ROWS = 256
#: Long conversations whose ids are sent to every task.
FEW = 10_000

DELETE, INSERT, LOST_END = 2, 5, 5
STATES = "esua"
SCORE = "struct<cost: long, audit: string>"
_BLANK, _LAST = r"\A[\x20\x09-\x0D]*\z", r"[.!?][\x20\x09-\x0D]*\z"
#: Legal neighbours among roles, by their initials.
LEGAL = ("su", "ua", "au")


def _plus(x: Column, cost: Column | int, letters: Column | str) -> Column:
    """x with an edit more; nothing where x can't be reached."""
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.when(x.isNotNull(), F.struct((x["cost"] + cost).cast("long").alias("cost"), F.concat(x["audit"], letters).alias("audit")))


def _bind(value: Column, body) -> Column:  # noqa: ANN001
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _states(e: Column, s: Column, u: Column, a: Column) -> Column:
    return F.struct(e.alias("e"), s.alias("s"), u.alias("u"), a.alias("a"))


def _with_inserts(x: Column) -> Column:
    """Before a turn: user and assistant may be put in; more than two in a row only repeat a state."""
    e, s, u, a = (x[k] for k in STATES)
    return _states(e, s, F.least(u, *(_plus(y, INSERT, "I") for y in (e, s, a))), F.least(a, _plus(u, INSERT, "I"), *(_plus(y, 2 * INSERT, "II") for y in (e, s))))


def _after_turn(x: Column, turn: Column) -> Column:
    """turn: its role's initial and its fault (`-` none, `t` truncated, `x` must go)."""
    initial, fault = turn["initial"], turn["fault"]
    stays, extra = fault != "x", F.when(fault == "t", LOST_END).otherwise(0)
    e, s, u, a = (x[k] for k in STATES)

    def put(froms: Column, to: str) -> Column:
        own = initial == to
        return F.when(stays, _plus(froms, extra + F.when(own, 0).otherwise(1), F.when(own, "K").otherwise("R")))

    system = F.when(stays & (initial == "s"), _plus(e, extra, "K"))
    gone = {k: _plus(x[k], DELETE, "D") for k in STATES}
    return _states(gone["e"], F.least(gone["s"], system), F.least(gone["u"], put(F.least(e, s, a), "u")), F.least(gone["a"], put(u, "a")))


def _fold(turns: Column, begin: str) -> Column:
    """The four scores after all turns, from one state."""
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    start = _states(*((zero if k == begin else F.lit(None)).cast(SCORE) for k in STATES))
    return F.aggregate(turns, start, lambda x, t: _bind(_with_inserts(x), lambda y: _after_turn(y, t)))


def _ended(x: Column) -> Column:
    """The best score with the end set right: an open user turn gets an answer, a lone system turn a pair."""
    return F.least(x["e"], x["a"], _plus(x["u"], INSERT, "I"), _plus(x["s"], 2 * INSERT, "II"))


def _illegal(initials: Column) -> Column:
    pairs = F.zip_with(initials, F.slice(initials, F.lit(2), F.size(initials)), lambda a, b: F.concat(a, b))
    return F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL)))


def _repaired(turns: Column, audit: Column, begin: Column) -> Column:
    """Turns after the edits of an audit that starts in a state: array of (role, text)."""
    letters = F.split(F.regexp_replace(audit, "I", ""), "")  # one a turn
    kept = _bind(letters, lambda own: F.filter(turns, lambda t, i: F.get(own, i) != "D"))
    units = F.regexp_extract_all(F.concat(F.lit("^"), F.regexp_replace(audit, "D", "")), F.lit("[\\^KR]I*"), F.lit(0))  # a turn and the inserts behind it
    new = F.struct(F.lit("I").alias("edit"), F.lit("").alias("role"), F.lit("").alias("text"))

    def put(turn: Column, unit: Column, i: Column) -> Column:
        own = F.when(i == 0, F.array().cast("array<struct<edit: string, role: string, text: string>>"))
        own = own.otherwise(F.array(F.struct(F.substring(unit, 1, 1).alias("edit"), turn["role"].alias("role"), turn["text"].alias("text"))))
        return F.concat(own, F.array_repeat(new, F.length(unit) - 1))

    def in_turn(out: Column) -> Column:
        opens = F.coalesce((F.get(out, F.lit(0))["edit"] == "K") & F.get(out, F.lit(0))["role"].startswith("s"), F.lit(False))
        odd = F.when((begin == "u") | opens, 1).otherwise(0)  # roles take turns from here on
        return F.transform(out, lambda t, j: F.struct(F.when(t["edit"] == "K", t["role"]).when((j + odd) % 2 == 0, "user").otherwise("assistant").alias("role"), t["text"].alias("text")))

    return _bind(_bind(kept, lambda turn: F.flatten(F.transform(units, lambda unit, i: put(F.get(turn, i - 1), unit, i)))), in_turn)


def _joined(repaired: Column) -> Column:
    return F.array_join(F.transform(repaired, lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")


def _clean(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone (a mark that only keeps its conversation), and what a turn says alone."""
    space = F.lit(" ")
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    out = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), gone.alias("gone"))
    return out.withColumns({"initial": F.substring("role", 1, 1), "blank": F.col("text").rlike(_BLANK), "open": ~F.col("text").rlike(_LAST)})


def _fault(duplicate: Column) -> Column:
    return F.when(F.col("blank"), "b").when(duplicate, "d").when(F.col("open"), "t").otherwise("-")


def _code(turns: Column) -> Column:
    return F.transform(turns, lambda t: F.struct(t["initial"].alias("initial"), F.when(t["fault"].isin("b", "d"), "x").otherwise(t["fault"]).alias("fault")))


FIGURES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that fit one row."""
    rows = rows.repartition("conv_id")  # serves the windows and the grouping alike
    again = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.asc_nulls_first("turn"))
    rows = rows.withColumn("again", F.row_number().over(again) > 1).withColumn("fault", _fault(F.col("again")))
    one = F.struct("turn", "role", "text", "again", "initial", "fault")
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(~F.col("gone"), one))).alias("turns"))
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    held = held.withColumn("best", _bind(_fold(_code(F.col("turns")), "e"), _ended)).withColumn("repaired", _repaired(F.col("turns"), F.col("best.audit"), F.lit("e")))

    def faults(kind: str) -> Column:
        return F.size(F.filter("turns", lambda t: t["fault"] == kind)).cast("long")

    return held.select(
        "conv_id",
        F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long").alias("gaps"),
        faults("b").alias("blank"), faults("d").alias("duplicate"), faults("t").alias("truncated"),
        _illegal(F.transform("turns", lambda t: t["initial"])).cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), "repaired",
        F.sha2(_joined(F.col("repaired")), 256).alias("repaired_sha256"),
    )


def _parts(rows: DataFrame, part_rows: int) -> tuple[DataFrame, DataFrame]:
    """Long conversations: (reports without digests, repaired parts)."""
    spark = rows.sparkSession
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.substring("text", 1, 64)]
    placed = rows.repartitionByRange(slots(spark), *order).sortWithinPartitions(*order, "text")
    placed = materialise(placed.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.col("at") - F.col("at") % part_rows))
    turn = placed.where(~F.col("gone"))
    # the first place of each text in its conversation; places are unique, so the join has no hot key
    first = turn.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    seen = turn.select("at", "conv_id", "part", "turn", "initial", "blank", "open").join(first, "at", "left").withColumn("fault", _fault(F.col("first").isNull()))
    light = F.sort_array(F.collect_list(F.struct("at", "initial", "fault")))
    is_a = lambda kind: F.count_if(F.col("fault") == kind)
    parts = seen.groupBy("conv_id", "part").agg(light.alias("turns"), is_a("b").alias("blank"), is_a("d").alias("duplicate"), is_a("t").alias("truncated"))
    initials = F.transform("turns", lambda t: t["initial"])
    parts = materialise(
        parts.select(
            "conv_id", "part", "blank", "duplicate", "truncated", _illegal(initials).alias("illegal"),
            F.get(initials, F.lit(0)).alias("head"), F.element_at(initials, -1).alias("tail"), F.transform("turns", lambda t: t["fault"]).alias("faults"),
            F.struct(*(_fold(_code(F.col("turns")), k).alias(k) for k in STATES)).alias("table"),
        )
    )

    def through(x: Column, table: Column) -> Column:
        """Scores (cost, audit, path of states) with a part more; audits alone decide, paths follow from them."""

        def to(k: str) -> Column:
            ways = [F.when(x[f].isNotNull() & table[f][k].isNotNull(), F.struct((x[f]["cost"] + table[f][k]["cost"]).alias("cost"), F.concat(x[f]["audit"], table[f][k]["audit"]).alias("audit"), F.concat(x[f]["path"], F.lit(k)).alias("path"))) for f in STATES]
            return F.least(*ways)

        return _states(*(to(k) for k in STATES))

    score = "struct<cost: long, audit: string, path: string>"
    start = _states(*((F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"), F.lit("").alias("path")) if k == "e" else F.lit(None)).cast(score) for k in STATES))
    listed = parts.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("part", "head", "tail"))).alias("ends"), F.sort_array(F.collect_list(F.struct("part", "table"))).alias("tables"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
    )

    def ended(x: Column) -> Column:
        ways = [F.when(x[k].isNotNull(), F.struct((x[k]["cost"] + cost).alias("cost"), F.concat(x[k]["audit"], F.lit(more)).alias("audit"), x[k]["path"].alias("path"), F.lit(more).alias("more"))) for k, cost, more in (("e", 0, ""), ("a", 0, ""), ("u", INSERT, "I"), ("s", 2 * INSERT, "II"))]
        return F.least(*ways)

    best = _bind(F.aggregate("tables", start, lambda x, p: through(x, p["table"])), ended)
    between = F.zip_with("ends", F.slice("ends", F.lit(2), F.size("ends")), lambda a, b: F.concat(a["tail"], b["head"]))
    listed = materialise(listed.withColumn("best", best).withColumn("illegal", F.col("illegal") + F.size(F.filter(between, lambda p: ~p.isin(*LEGAL)))))
    turns = placed.groupBy("conv_id").agg(F.max(F.when(~F.col("gone"), F.col("turn"))).alias("high"), F.min(F.when(~F.col("gone"), F.col("turn"))).alias("low"), F.count_distinct(F.when(~F.col("gone"), F.col("turn"))).alias("numbers"))
    zero = F.lit(0).cast("long")
    report = turns.alias("t").join(listed.alias("l"), F.expr("t.conv_id <=> l.conv_id"), "left").select(
        "t.conv_id", F.coalesce(F.col("high") - F.col("low") + 1 - F.col("numbers"), zero).alias("gaps"),
        *(F.coalesce(f"l.{c}", zero).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")),
        F.coalesce("best.cost", zero).alias("cost"), F.coalesce("best.audit", F.lit("")).alias("audit"),
    )
    # each part's own edits: its table's audit between the states where the best path enters and leaves it
    last = F.size("tables") - 1
    edits = listed.select("conv_id", "best.path", "best.more", F.posexplode("tables").alias("i", "p"), last.alias("last"))
    state = F.when(F.col("i") == 0, "e").otherwise(F.substring("path", F.col("i"), F.lit(1)))
    leaves = F.substring("path", F.col("i") + 1, F.lit(1))
    own = F.lit(None).cast("string")
    for f in STATES:
        for k in STATES:
            own = F.when((state == f) & (leaves == k), F.col("p.table")[f][k]["audit"]).otherwise(own)
    edits = edits.select("conv_id", F.col("p.part").alias("part"), state.alias("state"), F.concat(own, F.when(F.col("i") == F.col("last"), F.col("more")).otherwise("")).alias("audit"))
    texts = turn.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text"))).alias("turns"))
    done = texts.alias("x").join(edits.alias("y"), F.expr("x.conv_id <=> y.conv_id AND x.part = y.part"))
    return report, done.select("x.conv_id", "x.part", _repaired(F.col("turns"), F.col("audit"), F.col("state")).alias("repaired"))


def _digests(parts: DataFrame) -> DataFrame:
    """SHA-256 of each conversation's parts in order: a stream in one task, which holds one part at a time."""
    kind = parts.schema["conv_id"].dataType.simpleString()
    lines = parts.where(F.size("repaired") > 0).select("conv_id", "part", _joined(F.col("repaired")).alias("lines"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, None
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(2), strict=True):
                if state is None or key.as_py() != now:
                    if state is not None:
                        yield _one(out, state, batch.schema)
                    now, out, state = key.as_py(), key, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(text.as_py().encode())
            schema = batch.schema
        if state is not None:
            yield _one(out, state, schema)

    def _one(key: pa.Scalar, state, schema: pa.Schema) -> pa.RecordBatch:  # noqa: ANN001
        return pa.RecordBatch.from_arrays([pa.array([key.as_py()], schema.field(0).type), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

    sorted_ = lines.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return sorted_.mapInArrow(lean(digest), f"conv_id {kind}, repaired_sha256 string")


def _split(turns: DataFrame, long_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(turns of ordinary conversations, those of long ones or None)."""
    rows = _clean(turns)
    size = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    long_ids = materialise(size.where((F.col("n") > long_rows) | (F.col("bytes") > LONG_BYTES)).select("conv_id"))
    n = long_ids.count()
    if not n:
        return rows, None
    ids = F.broadcast(long_ids) if n <= FEW else long_ids
    on = rows["conv_id"].eqNullSafe(ids["conv_id"])
    return rows.join(ids, on, "left_anti"), rows.join(ids, on, "left_semi")


def repair(turns: DataFrame, long_rows: int = LONG_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """turns(conv_id, turn, role, text) -> a row a conversation: FIGURES, audit, repaired (null if long), repaired_sha256."""
    short, long = _split(turns, long_rows)
    out = _whole(short)
    if long is None:
        return out
    report, parts = _parts(long, part_rows)
    found = report.alias("r").join(_digests(parts).alias("d"), F.expr("r.conv_id <=> d.conv_id"), "left")
    more = found.select("r.conv_id", *FIGURES, "audit", F.lit(None).cast(out.schema["repaired"].dataType).alias("repaired"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
    return out.unionByName(more)


def repaired_turns(turns: DataFrame, long_rows: int = LONG_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """The repaired conversations as rows: conv_id, part, place (from 0 in its part), role, text."""
    short, long = _split(turns, long_rows)
    parts = _whole(short).select("conv_id", F.lit(0).cast("long").alias("part"), "repaired")
    if long is not None:
        parts = parts.unionByName(_parts(long, part_rows)[1])
    return parts.select("conv_id", "part", F.posexplode("repaired").alias("place", "t")).select("conv_id", "part", "place", "t.role", "t.text")


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's own faults, by crc32 of ``conv_id:turn``; dropped rows stay as marks (`gone`) of their conversation."""
    space = F.lit(" ")
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("k"))
    k = F.col("k")
    changed = rows.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (k == 0).alias("gone"), F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1))).alias("copy"),
    )
    return changed.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("repaired")
