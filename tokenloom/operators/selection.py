"""Small relational steps of the study: row filters, name folding, lookups with defaults, reference lines, orders of categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def generated_region(tokens: DataFrame, prompt_tokens: int) -> DataFrame:
    """Tokens from the last one of the prompt on: those that the model has predicted."""
    return tokens.where(F.col("pos") >= prompt_tokens - 1)


def named_without(rows: DataFrame, name: str, parts: list[str]) -> DataFrame:
    """Rows whose name holds none of the parts."""
    for part in parts:
        rows = rows.where(~F.contains(name, F.lit(part)))
    return rows


def without_noise(rows: DataFrame, label: str, noise: int = -1) -> DataFrame:
    """Rows of real clusters; null labels (no clustering) and the noise label go."""
    return rows.where(F.col(label).isNotNull() & (F.col(label) != noise))


def lively(rows: DataFrame, least: int, *by: str) -> DataFrame:
    """Rows of the clusterings with at least so many distinct labels."""
    good = rows.groupBy(*by).agg(F.count_distinct("label").alias("labels")).where(F.col("labels") >= least)
    return rows.join(good, [*by], "left_semi")


def nulled(value: Column, below: float) -> Column:
    """The value, null where it is nearer to zero than the bound."""
    return F.when(F.abs(value) >= below, value)


def folded(value: Column, synonyms: dict[str, str]) -> Column:
    """The value's common name, itself if it has none."""
    table = F.create_map(*[F.lit(x) for pair in synonyms.items() for x in pair])
    return F.coalesce(table[value], value)


def found(value: Column, table: dict[str, str], default: str) -> Column:
    """What a table of lower-case names holds for the value in any case, else the default."""
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[F.lower(value)], F.lit(default))


def slug(value: Column) -> Column:
    """A method's name as part of a file name."""
    return F.lower(F.replace(value, F.lit("-"), F.lit("_")))


def without_prefix(value: Column, prefix: str) -> Column:
    """The value without the prefix; null where it does not start with it."""
    return F.when(F.startswith(value, F.lit(prefix)), F.substr(value, F.lit(len(prefix) + 1)))


def signed(value: Column) -> Column:
    """A number with its sign and four decimals."""
    return F.format_string("%+.4f", value)


def flat_key(**parts: Column) -> Column:
    """Parts of a configuration as one key of a JSON report: name=value, joined by underscores."""
    return F.concat_ws("_", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in parts.items()])


def reference_line(ranks: DataFrame, fitted: DataFrame) -> DataFrame:
    """rank and expected: anchor times rank to the slope, for a fit of one row (slope, anchor)."""
    return ranks.crossJoin(F.broadcast(fitted)).select("rank", (F.col("anchor") * F.pow("rank", "slope")).alias("expected"))  # one row


def by_size(named: DataFrame) -> DataFrame:
    """category, clusters, tokens, place: categories of clusters (category, size), most tokens first; at most seven rows."""
    sums = named.groupBy("category").agg(F.count("*").alias("clusters"), F.sum("size").alias("tokens"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy().orderBy(F.desc("tokens"), "category")))


def vocabulary(tokens: DataFrame, most: int) -> DataFrame:
    """id, tok, n: the commonest tokens, numbered from 0; a list of `most` rows."""
    top = tokens.groupBy("tok").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tok").limit(most)
    return top.withColumn("id", F.row_number().over(Window.partitionBy().orderBy(F.desc("n"), "tok")) - 1).select("id", "tok", "n")


def whole_vocabulary(tokens: DataFrame) -> DataFrame:
    """id, tok, n: every distinct token, numbered from 0 in the order of its md5. Numbers within spans of the md5 are shifted by the tokens of the spans before, so no task orders the vocabulary."""
    h = F.md5(F.col("tok").cast("binary"))
    counted = tokens.groupBy("tok").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("span", F.substring("h", 1, 4))
    spans = counted.groupBy("span").agg(F.count("*").alias("size"))
    before = spans.select("span", (F.sum("size").over(Window.orderBy("span")) - F.col("size")).alias("before"))  # at most 16^4 rows
    place = F.row_number().over(Window.partitionBy("span").orderBy("h", "tok")) - 1
    return counted.join(F.broadcast(before), "span").select((place + F.col("before")).alias("id"), "tok", "n")


def decoded(ids: DataFrame, words: DataFrame) -> DataFrame:
    """ids (doc_id, pos, id) as strings: doc_id, text of their tokens in order."""
    named = ids.join(words.select("id", "tok"), "id")
    together = named.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("x"))  # tokens of one document
    return together.select("doc_id", F.array_join(F.transform("x", lambda e: e["tok"]), " ").alias("text"))
