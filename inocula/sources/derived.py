"""The twelve campaign tables derived from the driver's TPC-H-style testdata.

The testdata holds no campaign records, so every report runs on this fixed
derivation (one lazy DataFrame per table; Catalyst prunes whatever a report
does not read).  The same rules are written as DuckDB CTEs in
``inocula.oracle.DERIVED_CTES`` so the oracle sees identical tables.

Scale notes: the dimension-side inputs (region, nation, supplier) are tiny and
joined by size (AQE broadcast); every fact-side derivation (vaccination,
attends, transportationlog, diagnosis) is a grouped aggregate with map-side
partial aggregation, so a hot supplier/customer never lands whole in one task.
Groups by facility name use a number of the name, which is short to hash and
shuffle.
The supplier count ``N`` is a one-row global aggregate, used as a scalar
subquery (evaluated once, inlined as a value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import TABLES

RAW_TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def read_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


NAME_RANGES = 64  # of the suppliers' names, each ranked by itself


def _key(prefix: str, col) -> F.Column:
    return F.concat(F.lit(prefix), F.col(col).cast("string") if isinstance(col, str) else col.cast("string"))


def _days(start: str, n) -> F.Column:
    return F.date_add(F.lit(start).cast("date"), n.cast("int"))


def _conform(df: DataFrame, name: str) -> DataFrame:
    """Cast to the declared schema, in declared column order."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TABLES[name].schema])


class DerivedTables:
    """Lazy builders for the derived tables; ``tables()`` returns them all."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return read_raw(self.spark, self.sf_dir, name)

    def _supplier_count(self) -> DataFrame:
        # one row, always (a global aggregate): used as a scalar subquery
        return self.raw("supplier").agg(F.count(F.lit(1)).alias("_n"))

    def vaccine(self) -> DataFrame:
        r = self.raw("region")
        k = F.col("r_regionkey")
        return _conform(
            r.select(
                _key("V", "r_regionkey").alias("id"),
                F.col("r_name").alias("name"),
                (1 + k % 2).alias("dosage"),
                (-90 + 10 * k).alias("tempmin"),
                (-70 + 10 * k).alias("tempmax"),
            ),
            "vaccine",
        )

    def manufacturer(self) -> DataFrame:
        n = self.raw("nation")
        return _conform(
            n.select(
                _key("M", "n_nationkey").alias("id"),
                _key("09-", "n_nationkey").alias("phone"),
                F.col("n_name").alias("country"),
                _key("V", "n_regionkey").alias("vaccineid"),
            ),
            "manufacturer",
        )

    def healthcarefacility(self) -> DataFrame:
        s, n = self.raw("supplier"), self.raw("nation")
        return _conform(
            s.join(n, s.s_nationkey == n.n_nationkey).select(
                F.col("s_name").alias("name"),
                F.col("n_name").alias("address"),
                _key("040-", "s_suppkey").alias("phone"),
            ),
            "healthcarefacility",
        )

    def batch(self) -> DataFrame:
        p, s = self.raw("part"), self.raw("supplier")
        pk = F.col("p_partkey")
        p = p.withColumn("_sk", pk % (self._supplier_count().scalar() - 1))
        return _conform(
            p.join(s.select("s_suppkey", "s_name"), F.col("_sk") == F.col("s_suppkey")).select(
                _key("B", "p_partkey").alias("id"),
                F.col("p_size").alias("numberofvaccines"),
                _key("M", pk % 25).alias("manufacturerid"),
                _days("1995-01-01", pk % 365).alias("manufactureddate"),
                F.col("s_name").alias("healthcarefacilityname"),
                _days("1996-01-01", pk % 2000).alias("expirydate"),
            ),
            "batch",
        )

    def patient(self) -> DataFrame:
        c = self.raw("customer")
        ck = F.col("c_custkey")
        return _conform(
            c.select(
                _key("P", "c_custkey").alias("ssno"),
                F.col("c_name").alias("name"),
                F.when(ck % 101 == 100, F.lit(None).cast("date"))
                .otherwise(_days("1930-01-01", (ck * 7919) % 31000))
                .alias("birthday"),
                F.when(ck % 2 == 0, F.lit("F")).otherwise(F.lit("M")).alias("gender"),
                (ck % 3).alias("vaccinationstatus"),
            ),
            "patient",
        )

    def staff(self) -> DataFrame:
        c, s = self.raw("customer"), self.raw("supplier")
        ck = F.col("c_custkey")
        c = c.withColumn("_sk", ck % self._supplier_count().scalar())
        return _conform(
            c.join(s.select("s_suppkey", "s_name"), F.col("_sk") == F.col("s_suppkey")).select(
                _key("S", "c_custkey").alias("ssno"),
                F.col("c_name").alias("name"),
                _days("1950-01-01", (ck * 7919) % 18000).alias("birthday"),
                _key("041-", "c_custkey").alias("phone"),
                F.when(ck % 2 == 0, F.lit("doctor")).otherwise(F.lit("nurse")).alias("role"),
                F.when(ck % 13 == 12, F.lit(None).cast("int"))
                .otherwise(ck % 5 % 2)
                .alias("vaccinationstatus"),
                F.col("s_name").alias("healthcarefacilityname"),
            ),
            "staff",
        )

    def shift(self) -> DataFrame:
        c = self.raw("customer").select(
            "c_custkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("workday")
        )
        return _conform(
            c.where((F.col("c_custkey") + F.col("workday")) % 3 == 0).select(
                "workday", _key("S", "c_custkey").alias("ssno")
            ),
            "shift",
        )

    def _supplier_names(self) -> DataFrame:
        """(s_suppkey, s_name, _name): suppliers with a number of their name, in the names' order.

        Names are cut into ranges at some of them, chosen by hash, and ranked
        within their range: equal names have one number, others differ, the same
        on every run, and no task ranks all names.
        """
        s = self.raw("supplier").select("s_suppkey", "s_name")
        spread = F.xxhash64("s_name")
        chosen = s.groupBy(F.pmod(spread, F.lit(NAME_RANGES)).alias("_b")).agg(F.min_by("s_name", spread).alias("_at"))
        cuts = chosen.agg(F.collect_list("_at").alias("_cuts")).scalar()
        place = F.array_position(F.sort_array(F.array_append(cuts, F.col("s_name"))), F.col("s_name"))
        s = s.withColumn("_range", F.coalesce(place, F.lit(0)))
        rank = F.dense_rank().over(Window.partitionBy("_range").orderBy("s_name"))
        return s.select("s_suppkey", "s_name", (F.shiftleft("_range", 40) + rank).alias("_name"))

    def _named(self, df: DataFrame, number: str = "_name", name: str = "healthcarefacilityname") -> DataFrame:
        """``df`` with the facility name that a number stands for."""
        names = self._supplier_names().select(F.col("_name").alias(number), F.col("s_name").alias(name)).distinct()
        return df.join(names, number, "left")

    def _line_supplier(self) -> DataFrame:
        l, s = self.raw("lineitem"), self._supplier_names()
        return l.join(s.select("s_suppkey", "_name"), F.col("l_suppkey") == F.col("s_suppkey"))

    @staticmethod
    def _month_start(ts: str) -> F.Column:
        return F.trunc(F.col(ts).cast("date"), "month")

    def vaccination(self) -> DataFrame:
        events = (
            self._line_supplier()
            .groupBy(self._month_start("l_shipdate").alias("date"), "_name")
            .agg(F.min("l_partkey").alias("_part"))
        )
        return _conform(self._named(events).withColumn("batchid", _key("B", "_part")), "vaccination")

    def attends(self) -> DataFrame:
        o = self.raw("orders")
        # every line is an attendance: customers attend in pairs under the even
        # key, so odd patients have none; some attendees are not patients
        ck = F.col("o_custkey")
        even, stranger = ck - ck % 2, ck % 97 == 1
        # one customer key for each attendee, of whom it gives the name again
        one = F.when(stranger | (even % 97 == 1), ck).otherwise(even)
        attendee = F.when(stranger, _key("X", "o_custkey")).otherwise(_key("P", even))
        met = (
            self._line_supplier()
            # an order's key is its own: its side is a hash table, and the lines need no sort
            .join(o.select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
            .select(self._month_start("l_shipdate").alias("date"), "_name", one.alias("o_custkey"))
            .distinct()
        )
        return _conform(self._named(met).withColumn("ssno", attendee), "attends")

    @staticmethod
    def _symptom_name() -> F.Column:
        return F.concat(F.col("o_orderpriority"), F.lit("/"), F.col("o_orderstatus"))

    def symptoms(self) -> DataFrame:
        o = self.raw("orders")
        return _conform(
            o.select(
                self._symptom_name().alias("name"),
                F.when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(0).alias("criticality"),
            ).distinct(),
            "symptoms",
        )

    def diagnosis(self) -> DataFrame:
        o = self.raw("orders")
        return _conform(
            o.select(
                _key("P", "o_custkey").alias("ssno"),
                self._symptom_name().alias("symptom"),
                F.col("o_orderdate").cast("date").alias("date"),
            ).distinct(),
            "diagnosis",
        )

    def transportationlog(self) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        named = F.when(F.col("s_name").isNotNull(), F.col("_name"))
        t = self._supplier_names().select(F.col("s_suppkey").alias("t_key"), named.alias("_to"))
        to = (F.col("l_suppkey") + F.col("l_linenumber")) % self._supplier_count().scalar()
        trips = (
            self._line_supplier()
            .join(t, to == F.col("t_key"))
            .groupBy("l_partkey", "_name", day.alias("departuredate"))
            .agg(
                # numbers in the order of the names: a least text would be found by sorting all lines
                F.min("_to").alias("_to"),
                F.min(F.date_add(day, (F.col("l_orderkey") % 3).cast("int"))).alias("arrivaldate"),
            )
        )
        trips = self._named(self._named(trips, "_name", "fromlocation"), "_to", "tolocation")
        # a batch's trips side by side: files half as large, and quicker to group by batch
        trips = trips.sortWithinPartitions("l_partkey")
        return _conform(trips.withColumn("batchid", _key("B", "l_partkey")), "transportationlog")

    def tables(self) -> dict[str, DataFrame]:
        return LazyTables({name: getattr(self, name) for name in TABLES})


class LazyTables(dict):
    """A table dict whose DataFrames are built on first access.

    Building a DataFrame analyses its plan on the driver; a report that
    reads three tables should not pay for building all twelve.
    """

    def __init__(self, builders):
        super().__init__()
        self._builders = dict(builders)

    def __missing__(self, name):
        if name not in self._builders:
            raise KeyError(name)
        df = self._builders[name]()
        self[name] = df
        return df

    def __contains__(self, name):
        return name in self._builders

    def get(self, name, default=None):
        return self[name] if name in self._builders else default

    def __iter__(self):
        return iter(self._builders)

    def __len__(self):
        return len(self._builders)

    def keys(self):
        return self._builders.keys()

    def items(self):
        return [(n, self[n]) for n in self._builders]

    def values(self):
        return [self[n] for n in self._builders]


def derived_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All twelve campaign tables as lazy DataFrames over ``sf_dir``."""
    return DerivedTables(spark, sf_dir).tables()


def planted_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The derived tables with violations of every kind of rule put in."""
    clean = derived_tables(spark, sf_dir)
    number = F.substring("ssno", 2, 20).cast("bigint")

    def patient():
        p = clean["patient"]
        odd = p.withColumn("vaccinationstatus", F.when(number % 89 == 5, 7).otherwise(F.col("vaccinationstatus")))
        return odd.unionByName(p.where(number % 50 == 3))

    def staff():
        lost = F.when(number % 60 == 4, "nowhere").otherwise(F.col("healthcarefacilityname"))
        return clean["staff"].withColumn("healthcarefacilityname", lost)

    def attends():
        return clean["attends"].withColumn("date", F.when(number % 40 == 6, F.date_add("date", 1)).otherwise(F.col("date")))

    def symptoms():
        s = clean["symptoms"]
        critical = s.where("criticality = 1")
        twice = critical.withColumn("criticality", F.lit(3))
        return s.unionByName(twice).unionByName(critical.select(F.lit(None).cast("string").alias("name"), F.lit(0).alias("criticality")))

    def shift():
        s = clean["shift"]
        day = lambda w, to: s.where(F.col("workday") == w).withColumn("workday", F.lit(to).cast("int"))
        return s.unionByName(day(2, 9)).unionByName(day(3, None))

    planted = {"patient": patient, "staff": staff, "attends": attends, "symptoms": symptoms, "shift": shift}
    return LazyTables({n: planted.get(n, lambda n=n: clean[n]) for n in TABLES})


# ------------------------------------------------------------ raw sheets
# Two workbook sheets in their raw exported form (text columns, workbook
# headers, a filler column), derived from the testdata so the cleaning rules
# run on real volume: the Diagnosis sheet carries impossible calendar dates
# (day = orderkey mod 31 + 1 of the order's month) and missing dates
# (orderkey mod 97 = 0); the Shifts sheet carries weekday names, some of them
# unknown (custkey mod 11 = 0).


def raw_diagnosis_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_raw(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = F.concat(
        F.year("o_orderdate").cast("string"),
        F.lit("-"),
        F.lpad(F.month("o_orderdate").cast("string"), 2, "0"),
        F.lit("-"),
        F.lpad((k % 31 + 1).cast("string"), 2, "0"),
    )
    # spreadsheet exports write some dates with a time
    text = F.concat(text, F.when(k % 5 == 0, " 00:00:00").when(k % 5 == 1, " 13:45:10").otherwise(""))
    return o.select(
        _key("P", "o_custkey").alias("patient"),
        F.concat(F.col("o_orderpriority"), F.lit("/"), F.col("o_orderstatus")).alias("symptom"),
        F.when(k % 97 == 0, F.lit(None).cast("string")).otherwise(text).alias("date"),
        F.lit(None).cast("string").alias("Unnamed: 3"),
    )


def raw_shift_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_raw(spark, sf_dir, "customer").select(
        "c_custkey", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("w")
    )
    name = F.date_format(F.make_date(F.lit(2024), F.lit(1), F.col("w")), "EEEE")  # 2024-01-01 is a Monday
    return c.where((F.col("c_custkey") + F.col("w")) % 3 == 0).select(
        F.lit("station").alias("station"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit("Someday")).otherwise(name).alias("weekday"),
        _key("S", "c_custkey").alias("worker"),
    )
