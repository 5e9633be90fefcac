"""The long daily table and the dense panel over it.

``weekly_bars`` derives bars from order lines, ``Panel`` holds the dense grid: every
calendar day times every code, with nulls where there is no bar. Null means missing everywhere; NaN never occurs.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FIELDS = ("open", "high", "low", "close", "adj_close", "volume", "amount", "turn", "is_st", "is_trading")
FLOAT_SHARES = 500.0
LEAST_VOLUME = 10
UNCLASSIFIED = "未分类"


def code_of(key: str) -> Column:
    """A security code with a board prefix from a supplier key."""
    text = f"cast({key} as string)"
    return F.expr(f"concat(case pmod({key}, 4) when 0 then 'sh.600' when 1 then 'sz.000' when 2 then 'sz.300' else 'sh.688' end, lpad({text}, greatest(4, length({text})), '0'))")


def weekly_bars(lines: DataFrame) -> DataFrame:
    """One row per week and code that has order lines, in the long table's columns.

    Lines are grouped by the code itself, so that bars stand as the dense grid's join needs them and are not dealt out again.
    """
    price = F.col("l_extendedprice") / F.col("l_quantity")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")
    bars = lines.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("date"), code_of("l_suppkey").alias("code")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"),
        F.min((F.col("l_returnflag") == "R").cast("int")).cast("byte").alias("is_st"),
    )
    return bars.select(
        "date", "code", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume", "amount",
        F.least(F.lit(1.0), F.col("volume") / FLOAT_SHARES).alias("turn"), "is_st", (F.col("volume") >= LEAST_VOLUME).cast("byte").alias("is_trading"),
    )


def calendar_of(bars: DataFrame) -> DataFrame:
    """Distinct dates with their ordinal ``di``, from 0. One row per trading day, so a single ordered window is enough."""
    return bars.select("date").distinct().select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("di"))


def densify(bars: DataFrame, days: DataFrame, n_days: int) -> DataFrame:
    """The grid of every day and code; a code's days come from a sequence, not from a join."""
    codes = bars.select("code").distinct().select("code", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("di"))
    # a calendar has one row per day: some thousands, whatever the number of codes
    return codes.join(F.broadcast(days), "di").join(bars, ["date", "code"], "left").select("di", "date", "code", *FIELDS)


class Panel:
    """The dense panel of one data folder: persisted bars and calendar, read once."""

    _known: dict[tuple[str, str], Panel] = {}

    def __init__(self, bars: DataFrame) -> None:
        self.bars = bars.persist(StorageLevel.MEMORY_AND_DISK)
        self.calendar = calendar_of(self.bars).persist(StorageLevel.MEMORY_AND_DISK)
        self.n_days = self.calendar.count()
        self.grid = densify(self.bars, self.calendar, self.n_days).persist(StorageLevel.MEMORY_AND_DISK) if self.n_days else densify(self.bars, self.calendar, 1).limit(0)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Panel:
        """The panel over ``lineitem`` in ``sf_dir``; one per session and folder."""
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._known:
            cls._known[key] = cls(weekly_bars(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))
        return cls._known[key]

    def release(self) -> None:
        """Give the persisted tables back; the panel is read anew when it is asked for again."""
        for df in (self.grid, self.calendar, self.bars):
            df.unpersist()
        Panel._known = {k: p for k, p in Panel._known.items() if p is not self}

    def save(self, path: str) -> None:
        """The long table as Parquet, without its missing cells; repeated (date, code) rows raise."""
        check_unique(self.bars)
        self.bars.write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Panel:
        """A panel over a saved long table."""
        return cls(spark.read.parquet(path))

    def field(self, name: str) -> DataFrame:
        """One field as ``di, date, code, value``."""
        if name not in FIELDS:
            raise KeyError(name)
        return self.grid.select("di", "date", "code", F.col(name).alias("value"))

    def end_date(self):
        """The last day with a close."""
        return self.bars.where("close IS NOT NULL").agg(F.max("date").alias("d")).first()["d"]

    def wide(self, name: str) -> DataFrame:
        """A field as one column per code, by date: for sinks only. Repeated (date, code) rows raise."""
        check_unique(self.bars)
        return self.bars.groupBy("date").pivot("code").agg(F.first(name)).orderBy("date")


def check_unique(bars: DataFrame) -> None:
    """Raise if a (date, code) occurs twice."""
    twice = bars.groupBy("date", "code").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"repeated row: {twice[0]['date']} {twice[0]['code']}")


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, industry`` of every supplier; no nation gives the unclassified industry."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name")
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    found = suppliers.join(nations, suppliers["s_nationkey"] == nations["n_nationkey"], "left")
    return found.select(code_of("s_suppkey").alias("code"), F.coalesce(F.when(F.col("n_name") != "", F.col("n_name")), F.lit(UNCLASSIFIED)).alias("industry"))


def membership(bars: DataFrame) -> DataFrame:
    """Month-wise snapshots, dated at the month's last week with lines: all codes with a line in a week of the month, none of them later than the snapshot."""
    month = F.trunc("date", "MM")
    last = bars.groupBy(month.alias("month")).agg(F.max("date").alias("snap_date"))
    return bars.select(month.alias("month"), "code").distinct().join(last, "month").select("snap_date", "code")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``code, report_date, pub_date, value``: quarterly average line prices, published 10 to 99 days after the quarter."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    quarter = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    found = lines.groupBy("l_suppkey", quarter.alias("q")).agg(F.avg("l_extendedprice").alias("value"))
    report = F.last_day(F.add_months("q", 2))
    return found.select(code_of("l_suppkey").alias("code"), report.alias("report_date"), F.date_add(report, (F.lit(10) + F.col("l_suppkey") % 90).cast("int")).alias("pub_date"), "value")
