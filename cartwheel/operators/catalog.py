"""Catalogue: scans, key lookups, search, featured list, product cards."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwheel import schemas as S
from cartwheel.functions import status as st
from cartwheel.functions import text as tx
from cartwheel.functions.keys import ranked
from cartwheel.functions.money import money_text
from cartwheel.session import scratch_path

GRAM = 3
PAD = "\u0000"
LIST_ROWS = 4096             # products in one part of a gram's list


def products_all(products: DataFrame) -> DataFrame:
    return products.select(*S.PRODUCTS.names)


def product_by_id(products: DataFrame, product_id: int, seller_id: int | None = None) -> DataFrame:
    """Single-key lookup: a pushed-down filter on the scan."""
    cond = F.col("product_id") == F.lit(product_id)
    if seller_id is not None:
        cond = cond & (F.col("seller_id") == F.lit(seller_id))
    return products.where(cond)


def rows_by_keys(table: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Rows of any entity whose key is in ``keys`` (user, product, seller,
    order ...): a semi join, so duplicate requests never duplicate rows."""
    on = [on] if isinstance(on, str) else list(on)
    return table.join(keys.select(*on).distinct(), on, "left_semi")


def missing_keys(table: DataFrame, keys: DataFrame, on: list[str] | str) -> DataFrame:
    """Requested keys with no row (the shop's 'not found' branch)."""
    on = [on] if isinstance(on, str) else list(on)
    return keys.select(*on).distinct().join(table.select(*on), on, "left_anti")


def rows_by_email(table: DataFrame, emails: DataFrame) -> DataFrame:
    """The same lookup for a table of e-mails (column email), each asked once."""
    asked = emails.select(tx.email_key("email").alias("email_key")).where("email_key is not null").distinct()
    return table.withColumn("email_key", tx.email_key("email")).join(asked, "email_key", "left_semi")


def row_by_email(table: DataFrame, email: str) -> DataFrame:
    """Credentials-row lookup by e-mail, case-insensitive like the shop's
    collation (users or sellers)."""
    return table.where(tx.email_key("email") == F.lit(email.strip().lower()))


def product_lookup(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Batch of lookups by key and by (key, owner).

    ``requests``: request id column ``change_id``, ``product_id``, ``seller_id``.
    Each request is answered once: found / missing, and whether the sender
    owns the product (the guard of edit and delete).
    """
    p = products.select("product_id", F.col("seller_id").alias("_owner"), F.lit(1).alias("_hit"))
    return (requests.select("change_id", "product_id", "seller_id").join(p, "product_id", "left")
            .select("change_id", "product_id", "seller_id",
                    F.when(F.col("_hit").isNull(), F.lit("missing")).otherwise(F.lit("found")).alias("lookup"),
                    F.when(F.col("_owner").isNotNull() & (F.col("_owner") == F.col("seller_id")), F.lit("yes"))
                     .otherwise(F.lit("no")).alias("owned_by_sender")))


# Search -----------------------------------------------------------------------

@dataclass
class SearchIndex:
    """Inverted index of the texts' grams. ``postings`` (gram, part, product_id):
    every product a gram occurs in; a long list is split into parts of ``LIST_ROWS``
    products, so no join key holds a whole hot list. ``grams`` (gram, freq, parts)."""
    postings: DataFrame
    grams: DataFrame


def build_search_index(products: DataFrame, path: str | None = None) -> SearchIndex:
    """The index of the products' names and descriptions, written below ``path`` (or
    the scratch folder). Every place of a text starts a gram, the last ones being
    filled up with ``PAD``, so a run shorter than GRAM is a prefix of grams. Lists
    are cut by ``ranked``: a gram that every product has is spread over the range
    partitions its rows take."""
    texts = products.select("product_id", F.lower("name").alias("n"), F.lower("description").alias("d"))
    grams = F.array_distinct(F.concat(*[_grams(F.concat(F.coalesce(F.col(c), F.lit("")), F.lit(PAD * (GRAM - 1)))) for c in ("n", "d")]))
    rows = ranked(texts.select(F.explode(grams).alias("gram"), "product_id"), ["gram"], ["product_id"], "search-order", total="freq")
    parted = rows.select("gram", F.floor(F.col("rank") / LIST_ROWS).cast("int").alias("part"), "product_id", "freq")
    spark, path = products.sparkSession, path or scratch_path(products.sparkSession, "search-index")
    parted.select("gram", "part", "product_id").write.mode("overwrite").parquet(f"{path}/postings")
    parted.groupBy("gram").agg(F.max("freq").alias("freq"), (F.max("part") + 1).alias("parts")).write.mode("overwrite").parquet(f"{path}/grams")
    return read_search_index(spark, path)


def read_search_index(spark: SparkSession, path: str) -> SearchIndex:
    """An index written before."""
    return SearchIndex(spark.read.schema("gram string, part int, product_id long").parquet(f"{path}/postings"),
                       spark.read.schema("gram string, freq long, parts int").parquet(f"{path}/grams"))


def _grams(text: F.Column) -> F.Column:
    """All substrings of GRAM characters (none in a shorter text)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - GRAM + 1, F.lit(1)))
    return F.transform(F.when(F.length(text) >= GRAM, starts).otherwise(F.array().cast("array<int>")),
                       lambda i: F.substring(text, i, GRAM))


def _terms(terms: DataFrame) -> DataFrame:
    """Distinct terms with their pattern, literal runs (text between wildcards) and
    the longest run."""
    low = F.lower(F.coalesce(F.col("term"), F.lit("")))
    runs = F.filter(F.split(low, "[%_]"), lambda r: r != "")
    longest = F.aggregate(runs, F.lit(""), lambda best, r: F.when(F.length(r) > F.length(best), r).otherwise(best))
    return terms.select("term").distinct().select(
        "term", tx.like_contains_pattern(F.col("term")).alias("_pattern"), low.contains("_").alias("_single"),
        runs.alias("_runs"), longest.alias("_longest"))


def _place(run: F.Column, text: F.Column, start: F.Column) -> F.Column:
    return F.call_function("locate", run, text, start)


def _matches() -> F.Column:
    """Term test on pre-lowered text. Runs between '%' occur one after the other;
    taking each as early as it comes finds them if anything does, without a
    pattern compiled per row. '_' needs LIKE."""
    def one(text: F.Column) -> F.Column:
        end = F.aggregate("_runs", F.lit(1), lambda at, run: F.when(
            (at > 0) & (_place(run, text, at) > 0), _place(run, text, at) + F.length(run)).otherwise(F.lit(0)))
        return F.when(F.col("_single"), F.like(text, F.col("_pattern"), F.lit("\\"))).otherwise(end > 0)
    return F.coalesce(one(F.col("_name_l")), F.lit(False)) | F.coalesce(one(F.col("_desc_l")), F.lit(False))


def product_search(products: DataFrame, terms: DataFrame, index: SearchIndex | None = None) -> DataFrame:
    """(term, product_id) for every product whose name or description contains
    the term, case-insensitively; '%' and '_' in a term are wildcards and the
    empty term matches every product.

    Every literal run of a term occurs in a match, so any gram of any run is a
    complete key. A term is looked up by its rarest gram; one whose longest run is
    shorter than a gram takes the lists of all grams that start with it. The asked
    lists meet their products' texts first and the terms last, by (gram, part of its
    list): a (term, product) pair is tested exactly where it arises, and only hits
    leave the task, so the far more numerous candidates are neither kept nor
    shuffled. Terms without a literal character match by their wildcards alone and
    are joined to every product, which is what they ask for. ``index``: a stored
    one; without it, one is built.
    """
    index = index or build_search_index(products)
    t = _terms(terms)
    p = products.select("product_id", F.lower(F.col("name")).alias("_name_l"),
                        F.lower(F.col("description")).alias("_desc_l"))
    seeds = _long_seeds(t, index).unionByName(_short_seeds(t, index)).join(t, "term")
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    asked = seeds.select("gram", "parts").distinct().select("gram", part)
    # a product id of several rows is in a list several times; one is enough, the join brings all its rows
    once = Window.partitionBy("product_id", "gram").orderBy("part")
    listed = index.postings.where("product_id is not null").join(asked, ["gram", "part"], "left_semi").repartition("product_id") \
        .withColumn("_copy", F.row_number().over(once)).where("_copy = 1").drop("_copy")
    holds = F.contains("_name_l", "_longest") | F.contains("_desc_l", "_longest")
    hits = seeds.select("*", part).join(listed.join(p, "product_id"), ["gram", "part"]) \
        .where(holds & _matches() & _first_gram()).select("term", "product_id")
    wild = t.where(F.col("_longest") == "")
    return hits.unionByName(p.join(wild, _matches()).select("term", "product_id"))


def _first_gram() -> F.Column:
    """Of the grams that start with a run shorter than a gram, the one at the run's
    first place in the name, else in the description: a product with several of them
    is one hit. Longer runs are looked up by one gram alone."""
    def at(text: str) -> F.Column:
        padded = F.concat(F.col(text), F.lit(PAD * (GRAM - 1)))
        return F.when(F.contains(text, "_longest"), F.substring(padded, _place(F.col("_longest"), F.col(text), F.lit(1)), GRAM))
    return (F.length("_longest") >= GRAM) | (F.col("gram") == F.coalesce(at("_name_l"), at("_desc_l")))


def _long_seeds(t: DataFrame, index: SearchIndex) -> DataFrame:
    """(term, gram, parts): the rarest gram of each term; none if one of its grams
    occurs nowhere."""
    asked = t.where(F.length("_longest") >= GRAM) \
        .select("term", F.explode(F.array_distinct(F.flatten(F.transform("_runs", _grams)))).alias("gram"))
    rarest = asked.join(index.grams, "gram", "left").groupBy("term").agg(
        F.min(F.struct(F.coalesce("freq", F.lit(0).cast("long")).alias("freq"), "gram", "parts")).alias("s"))
    return rarest.where("s.freq > 0").select("term", "s.gram", "s.parts")


def _short_seeds(t: DataFrame, index: SearchIndex) -> DataFrame:
    """The same for terms whose longest run is shorter than a gram: every gram it
    starts."""
    run = F.col("_longest")
    asked = t.where((F.length(run) > 0) & (F.length(run) < GRAM)).select("term", run.alias("_run"))
    starts = index.grams.select("gram", "parts", F.explode(F.array(*[F.left("gram", F.lit(k)) for k in range(1, GRAM)])).alias("_run"))
    return asked.join(starts, "_run").select("term", "gram", "parts")


def featured_products(products: DataFrame, n: int = 4) -> DataFrame:
    """The first n products of the catalogue in key order (top-k: a
    TakeOrderedAndProject, no global sort)."""
    return products_all(products).orderBy("product_id").limit(n)


def product_cards(products: DataFrame) -> DataFrame:
    """Display fields of a product card: SKU, price text, excerpt, stock badge."""
    return products.select(
        "product_id", "name", tx.sku("product_id").alias("sku"), money_text("price").alias("price_text"),
        tx.excerpt("description", 80).alias("excerpt"), st.stock_badge("stock").alias("stock_badge"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """COUNT(*) per table, as one small DataFrame."""
    out = None
    for name, df in tables.items():
        one = df.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count")
        out = one if out is None else out.unionByName(one)
    return out
