"""Rollups kept up window by window, late corrections included: after any windows they equal a full derive.

Every table of a folder is a log: a step (one window) appends only the rows of the keys it changed, and the current
table is each key's row of the last step. So a step writes as much as changes, a step that is run again overwrites
itself, and one that failed leaves the steps before it as they were. ``compact`` folds a log to one step.

A step goes through five statements of the derivation, each on touched keys alone:

1. contracts and annexes are merged by key, the highest version wins whichever came first: a correction that comes late
   counts, an old version that comes again does not. Keys whose winner stays are not touched.
2. the rule makes the served rows of touched contracts, from their merged rows and all their annexes.
3. what is served differently gives signed rows: the old ones -1, the new ones +1.
4. pairs of authority and bidder add these up; the latest date, which can't be subtracted from, is read again from the served rows.
5. companies and authorities add up rows, and count partners by pairs that appear or vanish; sectors add up rows.

Defined results: rows without id (or key) are none; repeated rows count once; an empty window changes nothing; a contract
that a later version withdraws (``gone``) leaves all rollups; groups without rows have no row. Money is in whole cents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT = "id string, version long, gone boolean, unp string, authority string, bidder string, sector string, cents long, signed string"
ANNEX = "key string, version long, id string, published string, cents long"
SERVED = "id string, authority string, bidder string, sector string, cents long, flag string, signed string"
SUMS = "n long, cents long"
TABLES = {
    "contracts": (["id"], CONTRACT), "annexes": (["key"], ANNEX), "served": (["id"], SERVED),
    "pairs": (["authority", "bidder"], f"authority string, bidder string, {SUMS}, latest string"),
    "companies": (["bidder"], f"bidder string, {SUMS}, partners long"), "authorities": (["authority"], f"authority string, {SUMS}, partners long, latest string"),
    "sectors": (["sector"], f"sector string, {SUMS}"),
}

Rule = Callable[[DataFrame, DataFrame], DataFrame]


class Store:
    """The logs of one folder, as they are before a step."""

    def __init__(self, spark: SparkSession, folder: str, step: int) -> None:
        self.spark, self.folder, self.step = spark, folder, step
        self.done: set[str] = set()

    def log(self, name: str) -> DataFrame:
        """All rows of the steps before this one, and of this one where it is written."""
        path, schema = f"{self.folder}/{name}", TABLES[name][1]
        last = self.step if name in self.done else self.step - 1
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs_path):
            return self.spark.createDataFrame([], f"{schema}, step int")
        return self.spark.read.schema(f"{schema}, step int").parquet(path).where(F.col("step") <= last)

    def current(self, name: str, keys: DataFrame | None = None) -> DataFrame:
        """The table now, or only the rows of some keys."""
        by, rows = TABLES[name][0], self.log(name)
        if keys is not None:
            rows = _semi(rows, keys, keys.columns)
        columns = [c for c in rows.columns if c not in (*by, "step")]
        return rows.groupBy(*by).agg(F.max_by(F.struct(*columns), "step").alias("_r")).select(*by, "_r.*")

    def write(self, name: str, rows: DataFrame, beside: str = "") -> DataFrame:
        """This step's rows of a table; beside: further columns for this step alone, which the log doesn't show."""
        schema = TABLES[name][1] + beside
        rows.select(*(c.split()[0] for c in schema.split(", "))).write.mode("overwrite").parquet(f"{self.folder}/{name}/step={self.step}")
        self.done.add(name)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/step={self.step}")

    def kept(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows that this step reads several times, written once beside the tables."""
        path = f"{self.folder}/_{name}/step={self.step}"
        rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def _semi(rows: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Null-safe: groups without a name are groups. Ids and keys are never null in `keys`: by plain equality, so grouping by them needs no further shuffle."""
    if by in (["id"], ["key"]):
        return rows.join(keys.select(*by).distinct(), by, "left_semi").select(*rows.columns)
    k = keys.select(*(F.col(c).alias(f"_{c}") for c in by)).distinct()
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return rows.join(k, on, "left_semi")


def merge(store: Store, name: str, new: DataFrame) -> DataFrame:
    """The rows of keys whose winner changes; of one version the greater row wins.

    A key's rows in the log only ever grow, so its current one is the greatest: log and new rows meet in one grouping.
    """
    (key,), schema = TABLES[name]
    columns = [c.split()[0] for c in schema.split(", ")]
    new = new.select(*columns).where(F.col(key).isNotNull())
    value = F.struct(*(c for c in columns if c != key))  # the version comes first
    both = new.withColumn("_old", F.lit(False)).unionByName(store.log(name).select(*columns).withColumn("_old", F.lit(True)))
    best = both.groupBy(key).agg(F.max(value).alias("v"), F.max(F.when(F.col("_old"), value)).alias("was"))
    return store.write(name, best.where(~F.col("v").eqNullSafe(F.col("was"))).select(key, "v.*"))


def _sums(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.coalesce("cents", F.lit(0))).alias("cents"))


def _added(store: Store, name: str, delta: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Current rows of the delta's keys plus the delta; was: their n before. The log's rows and the delta meet in one grouping."""
    by, sums = TABLES[name][0], ("n", "cents", *extra)
    logged = store.log(name).select(*by, *sums, "step")
    both = logged.unionByName(delta.select(*by, *sums).withColumn("step", F.lit(None).cast("int")))
    fresh = F.col("step").isNull()
    added = both.groupBy(*by).agg(F.bool_or(fresh).alias("_hit"), F.max_by(F.struct(*sums), "step").alias("_r"), *(F.sum(F.when(fresh, F.col(c))).alias(f"_{c}") for c in sums))
    total = lambda c: (F.coalesce(F.col(f"_r.{c}"), F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).cast("long")
    return added.where("_hit").select(*by, *(total(c).alias(c) for c in sums), F.coalesce("_r.n", F.lit(0)).cast("long").alias("was"))


def apply_window(spark: SparkSession, folder: str, step: int, contracts: DataFrame, annexes: DataFrame, rule: Rule) -> None:
    """One window: contracts (CONTRACT) and annexes (ANNEX) that came, over the folder's steps before it."""
    store = Store(spark, folder, step)
    changed, changed_annexes = merge(store, "contracts", contracts), merge(store, "annexes", annexes)
    touched = changed.select("id").unionByName(changed_annexes.where("id is not null").select("id")).distinct()
    # an annex may have moved: the contract it stood at before is touched, too
    moved = _semi(Store(spark, folder, step).log("annexes"), changed_annexes.select("key"), ["key"]).where("id is not null").select("id")
    touched = store.kept("touched", touched.unionByName(moved).distinct())
    own = store.current("contracts", touched).where("NOT coalesce(gone, false)")
    old = store.current("served", touched).where("flag IS NOT NULL")
    now = rule(own, _by_contract(store, touched))
    fresh = touched.join(now, "id", "left")  # a contract that went has a row without a flag
    served = store.write("served", fresh)
    signed = served.where("flag IS NOT NULL").withColumn("sign", F.lit(1)).unionByName(old.withColumn("sign", F.lit(-1)))
    signed = store.kept("signed", signed.where("flag = 'ok'"))

    by = ["authority", "bidder"]
    pairs = _added(store, "pairs", _sums(signed, by)).alias("p")
    latest = store.current("served").where("flag = 'ok'").groupBy(*by).agg(F.max("signed").alias("latest")).alias("l")  # grouped before it travels
    on = F.expr("p.authority <=> l.authority AND p.bidder <=> l.bidder")
    joined = pairs.join(latest, on, "left").select("p.*", "l.latest").withColumn("appeared", (F.col("n") > 0).cast("long") - (F.col("was") > 0).cast("long"))
    joined = store.write("pairs", joined, ", appeared long")
    for name, key in (("companies", "bidder"), ("authorities", "authority")):
        partners = joined.groupBy(key).agg(F.sum("appeared").alias("partners"))
        delta = _full(_sums(signed, [key]), partners, key)
        out = _added(store, name, delta, ("partners",)).drop("was")
        if name == "authorities":
            last = store.current("pairs").where("n > 0").groupBy(key).agg(F.max("latest").alias("latest"))
            out = out.alias("o").join(last.alias("m"), F.expr(f"o.{key} <=> m.{key}"), "left").select("o.*", "m.latest")
        store.write(name, out)
    store.write("sectors", _added(store, "sectors", _sums(signed, ["sector"])).drop("was"))


def _full(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Sums of both by key; the same keys stand in both."""
    zero = F.lit(0).cast("long")
    both = a.withColumn("partners", zero).unionByName(b.select(key, zero.alias("n"), zero.alias("cents"), "partners"))
    return both.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("n", "cents", "partners")))


def _by_contract(store: Store, touched: DataFrame) -> DataFrame:
    """All annexes that stand at the touched contracts now."""
    keys = _semi(store.log("annexes"), touched, ["id"]).select("key")
    return _semi(store.current("annexes", keys), touched, ["id"])


def tables(spark: SparkSession, folder: str, step: int) -> dict[str, DataFrame]:
    """The rollups and served rows after a step; groups without rows are left out."""
    store = Store(spark, folder, step + 1)
    out = {n: store.current(n).where("n > 0") for n in ("pairs", "companies", "authorities", "sectors")}
    return out | {"served": store.current("served").where("flag IS NOT NULL")}


def full(contracts: DataFrame, annexes: DataFrame, rule: Rule) -> dict[str, DataFrame]:
    """The same tables derived at once from all rows that ever came."""

    def best(rows: DataFrame, key: str) -> DataFrame:
        columns = [c for c in rows.columns if c != key]
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*columns)).alias("v")).select(key, "v.*")

    plain = lambda schema: [c.split()[0] for c in schema.split(", ")]
    served = rule(best(contracts.select(*plain(CONTRACT)), "id").where("NOT coalesce(gone, false)"), best(annexes.select(*plain(ANNEX)), "key"))
    ok = served.where("flag = 'ok'")
    count, cents = F.count("*").alias("n"), F.sum(F.coalesce("cents", F.lit(0))).alias("cents")
    distinct: Callable[[str], Column] = lambda c: F.count_distinct(F.struct(c)).alias("partners")  # noqa: E731  a null partner is one
    return {
        "pairs": ok.groupBy("authority", "bidder").agg(count, cents, F.max("signed").alias("latest")), "companies": ok.groupBy("bidder").agg(count, cents, distinct("authority")),
        "authorities": ok.groupBy("authority").agg(count, cents, distinct("bidder"), F.max("signed").alias("latest")), "sectors": ok.groupBy("sector").agg(count, cents), "served": served,
    }


def compact(spark: SparkSession, folder: str, step: int, target: str) -> None:
    """The logs up to a step as one step of another folder."""
    store, out = Store(spark, folder, step + 1), Store(spark, target, step)
    for name in TABLES:
        out.write(name, store.current(name))
