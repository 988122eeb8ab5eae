"""A synthetic dirty order table with its ground truth, made by Spark.

Every pseudo-random number is a digest of (seed, purpose, row), so the tables are the same however they are partitioned, and
any SQL engine that has MD5 can say what they hold. Customers are numbered from 1 without gaps.
"""

from __future__ import annotations

import json
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.addresses import COUNTRY, PROVINCES
from ..operators.ages import number_words
from ..functions.cells import outside
from ..functions.text import lookup, two_decimals

# Fixed values of the data set.
CATEGORIES = ["Electronics", "Clothing", "Home & Garden", "Groceries", "Books", "Toys & Games", "Sports & Outdoors", "Beauty & Personal Care"]
SEGMENT_SHARES = {"Budget": 0.35, "Regular": 0.35, "Premium": 0.20, "New": 0.10}
SEGMENT_ORDERS = {"Budget": (8, 16), "Regular": (3, 8), "Premium": (1, 4), "New": (1, 2)}  # fewest and most
SEGMENT_ADJUSTMENTS = {"Budget": -45.0, "Regular": 0.0, "Premium": 150.0, "New": 15.0}
PAYLOADS = ["Robert'); DROP TABLE customers;--", "Alice'); DROP TABLE cleaned_records;--"]
TYPO_DOMAINS = ["gmial.com", "hotnail.com", "yaho.com", "outlok.com"]
FIRST_NAMES = "Ada Ali Ayla Can Deniz Ece Efe Elif Emre Filiz Kaya Lale Mert Nil Ozan Selin Tuna Umut Yasemin Zeki".split()
LAST_NAMES = "Acar Aksoy Arslan Aydin Bulut Demir Dogan Erdem Kara Kaplan Koc Ozturk Polat Sahin Tekin Toprak Uslu Yalcin Yildiz Yilmaz".split()
END = "2026-07-01"
HISTORY_MONTHS = 18
SPIKE_MONTH, SPIKE = "2025-12", 2.75
OUTLIERS, AMBIGUOUS_SHARE = 5, 0.015
#: Dates of these days of a month can be read in two ways.
EARLY_DAYS = 12
COLUMNS = "customer_id name email phone signup_date order_date address order_amount currency_hint customer_age category customer_segment".split()


#: Customers whose orders of a day are numbered in one task, and row numbers that a manifest lists.
CUSTOMERS_A_BLOCK, MOST_LISTED = 50_000, 10_000
#: Rows of a written file at most; and those that are worth a file of their own while there are less than four files a core.
ROWS_A_FILE, LEAST_ROWS_A_FILE = 1_000_000, 50_000
#: Blocks of a day that are broadcast; more are joined. Row numbers that are made at once.
FEW, NUMBERS_AT_ONCE = 200_000, 100_000


def kth_smallest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest 64-bit number of a column, or the largest if there are fewer: sixteen bits at a time, from counts."""
    bits = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))  # in the order of the numbers, without a sign
    high, skipped, found = 0, 0, None
    for shift in (48, 32, 16, 0):
        part = rows if shift == 48 else rows.where(F.shiftrightunsigned(bits, shift + 16) == F.lit(high))
        digit = F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 16) - 1)).cast("int")
        counts = sorted(tuple(r) for r in part.where(F.col(column).isNotNull()).groupBy(digit.alias("digit")).count().collect())  # at most 65,536 rows
        if not counts:
            return None
        for found, n in counts:
            if skipped + n >= k:
                break
            skipped += n
        high = (high << 16) | found
    return high - (1 << 63)


class Dice:
    def __init__(self, seed: int):
        self.seed = seed

    def number(self, purpose: str, digits: int, *keys: str) -> Column:
        """Of so many hexadecimal digits, at most 15."""
        text = F.concat_ws("/", F.lit(str(self.seed)), F.lit(purpose), *[F.col(k).cast("string") for k in keys])
        return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")

    def share(self, purpose: str, *keys: str) -> Column:
        """In [0, 1)."""
        return self.number(purpose, 10, *keys) / F.lit(float(1 << 40))

    def lot(self, purpose: str, *keys: str) -> Column:
        """As good as unique."""
        return self.number(purpose, 15, *keys)

    def whole(self, purpose: str, low: int, high: int, *keys: str) -> Column:
        """low to high, both included."""
        return (F.lit(low) + F.floor(self.share(purpose, *keys) * (high - low + 1))).cast("int")

    def pick(self, purpose: str, values: list[str], *keys: str) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), self.whole(purpose, 1, len(values), *keys))

    def normal(self, purpose: str, *keys: str) -> Column:
        u, v = 1 - self.share(purpose + "/u", *keys), self.share(purpose + "/v", *keys)
        return F.sqrt(-2 * F.log(u)) * F.cos(v * 6.283185307179586)

    def weighted(self, purpose: str, shares: list[float], values: list[Column], *keys: str) -> Column:
        return self.by_share(self.share(purpose, *keys), shares, values)

    @staticmethod
    def by_share(x: Column, shares: list[float], values: list[Column]) -> Column:
        out = values[-1]
        for bound, value in reversed(list(zip(accumulate(shares), values))[:-1]):
            out = F.when(x < bound, value).otherwise(out)
        return out


def customers(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return people(spark.range(1, n + 1).select(F.col("id").alias("customer_id")), seed)


def people(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A customer for each customer_id."""
    d, k = Dice(seed), "customer_id"
    # Numbers are few bytes, and a table of them few files: they are dealt to all cores before anything is made of them.
    ids = ids.select(F.col(k).cast("bigint").alias(k)).repartition(2 * ids.sparkSession.sparkContext.defaultParallelism, k)
    name = F.concat_ws(" ", d.pick("first", FIRST_NAMES, k), d.pick("last", LAST_NAMES, k))
    place = d.pick("city", list(PROVINCES), k)
    base = ids.withColumns({"name_true": name, "city": place, "segment": d.weighted("segment", list(SEGMENT_SHARES.values()), [F.lit(s) for s in SEGMENT_SHARES], k)})
    towns = F.try_element_at(F.create_map(*[x for p, inner in PROVINCES.items() for x in (F.lit(p), F.array(*[F.lit(t) for t in inner]))]), F.col("city"))
    return base.withColumns(
        {
            "district": F.when(outside(F.col(k).isNotNull()), F.element_at(towns, (F.floor(d.share("district", k) * F.size(towns)) + 1).cast("int"))),
            "email_true": F.concat(F.lower(F.replace("name_true", F.lit(" "), F.lit("."))), F.col(k), F.lit("@example.com")),
            "digits": F.concat(F.lit("53"), F.lpad(F.floor(d.share("phone", k) * 100_000_000).cast("string"), 8, "0")),
            "signup_date_true": F.date_sub(F.lit(END).cast("date"), d.whole("signup", 200, 1800, k)),
            "age_true": d.whole("age", 18, 75, k),
            "payload": F.when(F.col(k) <= len(PAYLOADS), F.element_at(F.array(*[F.lit(p) for p in PAYLOADS]), F.least(F.col(k), F.lit(len(PAYLOADS))).cast("int"))),
        }
    )


# Many digests side by side make a generated method too large for the JVM to compile, and many times slower. Beside an array function
# (`outside`) a projection is made by methods of moderate size.


def _adjusted(people: DataFrame) -> DataFrame:
    return people.withColumn("adjust", lookup(SEGMENT_ADJUSTMENTS, F.col("segment")))


def usual_orders(people: DataFrame, seed: int = 42) -> DataFrame:
    d = Dice(seed)
    least, most = [lookup({k: v[i] for k, v in SEGMENT_ORDERS.items()}, F.col("segment")) for i in (0, 1)]
    count = (least + F.floor(d.share("orders", "customer_id") * (most - least + 1))).cast("int")
    # Orders fall evenly into the last 18 months, or the time since the customer signed up if that is shorter.
    end = F.lit(END).cast("date")
    start = F.greatest("signup_date_true", F.date_sub(end, 30 * HISTORY_MONTHS))
    rows = _adjusted(people).withColumn("start", start).withColumn("order_no", F.explode(F.sequence(F.lit(1), count)))
    keys = ("customer_id", "order_no")
    day = F.floor(d.share("day", *keys) * (F.greatest(F.lit(1), F.datediff(end, F.col("start"))) + 1)).cast("int")
    category = F.when(outside(F.col("order_no").isNotNull()), d.pick("category", CATEGORIES, *keys))
    return rows.withColumns({"order_date_true": F.date_add("start", day), "category": category}).drop("start")


def spike_orders(people: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n orders with numbers of their own, dealt to customers."""
    d, keys = Dice(seed), ("customer_id", "order_no")
    last = people.agg(F.max("customer_id")).scalar()
    extra = people.sparkSession.range(1, n + 1).select((F.lit(1_000_000) + F.col("id")).cast("int").alias("order_no"))
    extra = extra.withColumn("customer_id", F.floor(d.share("extra", "order_no") * last).cast("bigint") + 1)
    days = {"order_date_true": F.date_add(F.lit(SPIKE_MONTH + "-01").cast("date"), d.whole("extra day", 0, 27, *keys)), "category": F.lit(CATEGORIES[0])}
    return extra.join(_adjusted(people), "customer_id").withColumns(days)


def _local(spark: SparkSession, columns: dict[str, pa.Array]) -> DataFrame:
    """A few rows of the driver, without Python workers."""
    return spark.createDataFrame(pa.table(columns))


def labelled(customers_: DataFrame, seed: int = 42) -> DataFrame:
    """The orders of customers as they truly are, numbered by row_index, those marked that become outliers or ambiguous. Row numbers
    grow from part to part, and within a part by order_date_true, customer_id, order_no."""
    d = Dice(seed)
    k = "row_index"
    spark = customers_.sparkSession
    # Orders are counted day by day, and within a day by blocks of customers: a block's first number is the count of all rows of
    # earlier days and blocks. No task holds more than a part and a block of a day.
    cell = ["order_date_true", "block"]
    blocks = lambda rows: rows.withColumn("block", F.floor(F.col("customer_id") / F.lit(CUSTOMERS_A_BLOCK)).cast("int"))
    usual = blocks(usual_orders(customers_, seed))
    counted = usual.groupBy(*cell).agg(F.count("*").alias("n"), F.count_if(F.col("category") == CATEGORIES[0]).alias("mine")).persist()
    # The spike: a month of one category is repeated, with numbers of its own, until it is so many times the usual month.
    months = counted.groupBy(F.date_format("order_date_true", "yyyy-MM").alias("m")).agg(F.sum("mine").alias("n")).where("n > 0")
    facts = months.agg(F.avg(F.when(F.col("m") != SPIKE_MONTH, F.col("n"))).alias("usual"), F.coalesce(F.max(F.when(F.col("m") == SPIKE_MONTH, F.col("n"))), F.lit(0)).alias("have"))
    wanted = F.greatest(F.lit(0), F.round(F.col("usual") * SPIKE) - F.col("have")).cast("bigint")
    extra = blocks(spike_orders(customers_, facts.select(wanted).first()[0] or 0, seed))  # one number comes to the driver, and tasks make the rows
    of_extra = extra.groupBy(*cell).agg(F.count("*").alias("n"))
    counts = counted.select(*cell, "n").unionByName(of_extra).groupBy(*cell).agg(F.sum("n").alias("n")).persist()  # a row a block of a day
    days, n_rows, n_cells = [], 0, 0
    for day, n, cells in counts.groupBy("order_date_true").agg(F.sum("n"), F.count("*")).orderBy("order_date_true").collect():  # some hundreds
        days.append((day, n_rows, n))
        n_rows, n_cells = n_rows + n, n_cells + cells
    counted.unpersist()
    parts = max(1, -(-n_rows // ROWS_A_FILE), min(4 * spark.sparkContext.defaultParallelism, n_rows // LEAST_ROWS_A_FILE))
    firsts = F.broadcast(_local(spark, {"order_date_true": pa.array([day for day, _, _ in days], pa.date32()), "before": pa.array([before for _, before, _ in days], pa.int64())}))
    earlier = F.sum("n").over(Window.partitionBy("order_date_true").orderBy("block")) - F.col("n")
    bases = counts.withColumn("earlier", earlier).join(firsts, "order_date_true").select(*cell, (F.col("before") + F.col("earlier")).alias("base"))
    bases = bases.withColumn("part", F.floor(F.col("base") / F.lit(max(1, -(-n_rows // parts)))).cast("int"))
    bases = bases.select(*cell, "part", F.min("base").over(Window.partitionBy("part")).alias("first"))
    keys = ("customer_id", "order_no")
    amount = F.greatest(F.lit(8.0), 30 + 5.5 * F.col("age_true") + F.col("adjust") + 18 * d.normal("noise", *keys))
    rows = usual.unionByName(extra).withColumn("amount_true", F.when(outside(F.col("order_no").isNotNull()), amount)).drop("adjust")
    # Every row goes to its part by the part's number, once; what is made of rows after that needs no shuffle.
    rows = rows.join(F.broadcast(bases) if n_cells <= FEW else bases, cell).drop("block").repartitionById(parts, "part")
    within = Window.partitionBy("part").orderBy("order_date_true", *keys)
    rows = rows.withColumn(k, (F.col("first") + F.row_number().over(within) - 1).cast("bigint")).drop("first")
    # What is drawn depends on row numbers alone, and those of a day are a range, so nothing is generated again to draw.
    drawn = spark.range(n_rows).toDF(k).withColumn("lot", d.lot("outlier", k))  # named, or every comparison would make two digests
    odd = [r[0] for r in drawn.orderBy("lot", k).limit(OUTLIERS).collect()]
    bounds = [(before, before + n - 1) for day, before, n in days if day.day <= EARLY_DAYS]
    early = _local(spark, {name: pa.array([b[i] for b in bounds], pa.int64()) for i, name in enumerate(("low", "high"))})
    chunks = early.select("high", F.explode(F.sequence("low", "high", F.lit(NUMBERS_AT_ONCE).cast("bigint"))).alias("low"))
    numbers = chunks.select(F.explode(F.sequence("low", F.least("high", F.col("low") + (NUMBERS_AT_ONCE - 1)))).alias(k))
    # The ambiguous rows are those with the smallest lots; a lot is as good as unique, so its bound says which.
    lots = numbers.select(d.lot("vague", k).alias("lot")).persist()
    bound = kth_smallest(lots, "lot", max(3, round(n_rows * AMBIGUOUS_SHARE)))
    lots.unpersist()
    vague = (F.dayofmonth("order_date_true") <= EARLY_DAYS) & (d.lot("vague", k) <= F.lit(-1 if bound is None else bound))
    rows = rows.withColumns({"is_outlier": F.col(k).isin(odd), "is_ambiguous": vague})
    return rows.withColumn("order_amount_true", F.round(F.when(F.col("is_outlier"), F.col("amount_true") * (8 + 10 * d.share("factor", k))).otherwise(F.col("amount_true")), 2)).drop("amount_true")


def tables(rows: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """What is made of labelled orders: the dirty table and its ground truth, both with row_index."""
    d, k = Dice(seed), "row_index"
    # What several cells or branches need is made once, in a projection before theirs.
    drawn = {f"_{p}": d.share(p, k) for p in ("signup format", "order format", "phone style", "email style", "age style")}
    drawn |= {"_style": d.whole("currency", 0, 3, k), "_at": d.whole("digit", 1, 10, k), "_whole": F.round("order_amount_true").cast("bigint"), "_cents": two_decimals(F.col("order_amount_true"))}
    rows = rows.withColumns(drawn | {"_outside": outside(F.col(k).isNotNull())})
    share = lambda purpose: F.col(f"`_{purpose}`")

    def date(purpose: str, c: str) -> Column:
        return d.by_share(share(purpose), [0.40, 0.25, 0.20, 0.15], [F.date_format(c, f) for f in ("yyyy-MM-dd", "dd/MM/yyyy", "MM-dd-yyyy", "MMMM dd, yyyy")])

    whole, cents, style = F.col("_whole"), F.col("_cents"), F.col("_style")
    grouped = F.replace(F.format_number(whole, 0), F.lit(","), F.lit("."))
    amount = F.when(style == 0, F.concat(F.lit("$"), cents)).when(style == 1, F.concat(grouped, F.lit(" TL"))).when(style == 2, F.replace(cents, F.lit("."), F.lit(","))).otherwise(F.concat(F.lit("₺"), whole))
    p, at = F.col("digits"), F.col("_at")
    part = lambda i, n: F.substring(p, i, n)
    spaced = F.concat_ws(" ", part(1, 3), part(4, 3), part(7, 2), part(9, 2))
    typo = F.concat(F.lit("+90"), F.substring(p, F.lit(1), at - 1), F.pmod(F.substring(p, at, F.lit(1)).cast("int") + d.whole("typo", 1, 9, k), F.lit(10)).cast("string"), F.substring(p, at + 1, F.lit(10)))
    short = F.concat(F.lit("+90"), F.substring(p, F.lit(1), at - 1), F.substring(p, at + 1, F.lit(10)))
    doubled = F.concat(F.lit("+90  "), part(1, 3), F.lit("   "), part(4, 3), F.lit(" "), part(7, 2), F.lit("  "), part(9, 2), F.lit(" "))
    phone = d.by_share(share("phone style"), [0.2] * 5, [F.concat(F.lit("+90 "), spaced), F.concat(F.lit("0"), spaced), doubled, typo, short])
    phone = F.when(outside(F.col("_outside")), phone)
    local = F.substring_index("email_true", "@", 1)
    email = d.by_share(share("email style"), [1 / 3] * 3, [F.concat(local, F.lit("@"), d.pick("domain", TYPO_DOMAINS, k)), F.concat(F.lit(" "), F.col("email_true"), F.lit(" ")), F.col("email_true")])
    no_district, no_country = d.share("no district", k) < 0.15, d.share("no country", k) < 0.10
    district, country = F.when(~no_district, F.col("district")), F.when(~no_country, F.lit(COUNTRY))
    address = F.when(d.share("order of parts", k) < 0.5, F.concat_ws(", ", country, F.col("city"), district)).otherwise(F.concat_ws(" - ", district, F.col("city"), country))
    words = lookup({v: w.replace(" ", "-") for w, v in number_words().items()}, F.col("age_true"))
    age = d.by_share(share("age style"), [0.75, 0.12, 0.10, 0.03], [F.col("age_true").cast("string"), F.concat(F.lit(" "), F.col("age_true"), F.lit(" ")), words, F.lit("")])
    dirty = rows.select(
        k, F.col("customer_id").cast("string").alias("customer_id"), F.coalesce("payload", "name_true").alias("name"), email.alias("email"), phone.alias("phone"), date("signup format", "signup_date_true").alias("signup_date"),
        F.when(F.col("is_ambiguous"), F.date_format("order_date_true", "dd/MM/yyyy")).otherwise(date("order format", "order_date_true")).alias("order_date"), address.alias("address"), amount.alias("order_amount"),
        F.when(style == 0, "USD").when(style == 2, "").otherwise("TRY").alias("currency_hint"), age.alias("customer_age"), "category", F.col("segment").alias("customer_segment"),
    )
    truth = rows.select(
        k, "customer_id", "name_true", "email_true", F.concat(F.lit("+90"), p).alias("phone_true_e164"), F.col("signup_date_true").cast("string"), F.col("order_date_true").cast("string"), F.col("city").alias("city_true"),
        F.col("district").alias("district_true"), F.lit(COUNTRY).alias("country_true"), "order_amount_true", F.col("age_true").alias("customer_age_true"),
    )
    return dirty, truth


def manifest_of(rows: DataFrame, n_customers: int, seed: int = 42) -> dict:
    """What is to be found in labelled orders."""
    k = "row_index"
    hundredths = lambda n, of: (2 * n + of) // (2 * of) / 100  # noqa: E731  in whole numbers, half up
    spike = rows.where(F.col("category") == CATEGORIES[0]).groupBy(F.date_format("order_date_true", "yyyy-MM").alias("m")).count().groupBy().agg(F.avg(F.when(F.col("m") != SPIKE_MONTH, F.col("count"))).alias("a"), F.max(F.when(F.col("m") == SPIKE_MONTH, F.col("count"))).alias("b")).first()
    kinds = {"sql_injection_rows": F.col("payload").isNotNull(), "ambiguous_date_rows": F.col("is_ambiguous"), "outlier_rows": F.col("is_outlier")}
    facts = rows.agg(F.count("*").alias("n"), F.corr("age_true", "order_amount_true").alias("r"), *[F.count_if(c).alias(name) for name, c in kinds.items()]).first()
    # Rows are listed while they are few; of more the truth table tells which they are.
    listed = lambda name: sorted(r[0] for r in rows.where(kinds[name]).select(k).collect()) if facts[name] <= MOST_LISTED else facts[name]
    return {
        "seed": seed, "n_customers": n_customers, "n_orders": facts["n"], **{name: listed(name) for name in kinds},
        "seasonal_anomaly": {"category": CATEGORIES[0], "month": SPIKE_MONTH, "normal_avg_monthly_count": round(spike["a"], 1), "spike_month_count": spike["b"], "spike_multiplier": round(spike["b"] / spike["a"], 2)},
        "age_amount_correlation": {"pearson_r": round(facts["r"], 3)},
        "segment_pattern": {r["segment"]: {"avg_orders_per_customer": hundredths(100 * r["o"], r["c"]), "avg_amount": hundredths(r["cents"], r["o"])} for r in rows.groupBy("segment").agg(F.count("*").alias("o"), F.countDistinct("customer_id").alias("c"), F.sum(F.round(F.col("order_amount_true") * 100).cast("bigint")).alias("cents")).collect()},
    }


def generate(spark: SparkSession, n_customers: int = 500, seed: int = 42) -> tuple[DataFrame, DataFrame, dict]:
    """The dirty table, its ground truth (both with row_index) and a manifest."""
    rows = labelled(customers(spark, n_customers, seed), seed)
    return *tables(rows, seed), manifest_of(rows, n_customers, seed)


def write(spark: SparkSession, path: str, n_customers: int = 500, seed: int = 42) -> dict:
    """Both tables as CSV, the manifest and a dictionary of the columns as text."""
    return write_for(customers(spark, n_customers, seed), path, n_customers, seed)


def write_for(customers_: DataFrame, path: str, n_customers: int, seed: int = 42) -> dict:
    spark = customers_.sparkSession
    rows = labelled(customers_, seed).persist()
    manifest = manifest_of(rows, n_customers, seed)
    # In order, a file a part; the files' names keep the order. No row is shuffled again.
    ordered = rows.sortWithinPartitions("part", "order_date_true", "customer_id", "order_no")
    for name, df in zip(("dirty", "truth"), tables(ordered, seed)):
        df.drop("row_index").write.mode("overwrite").csv(f"{path}/{name}", header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)  # blanks are part of the dirt
    _local(spark, {"value": pa.array([json.dumps(manifest)])}).coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    lines = [f"{c}: text" for c in COLUMNS] + [f"Rows: {manifest['n_orders']}; customers: {n_customers}; seed: {seed}."]
    _local(spark, {"value": pa.array(lines)}).coalesce(1).write.mode("overwrite").text(f"{path}/dictionary")
    rows.unpersist()
    return manifest
