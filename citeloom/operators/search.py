"""Search over records: a stored inverted index of short substrings, and exact answers from it.

A record's fields are joined by spaces and lower-cased. Its distinct substrings of one, two and three characters are postings
(gram, n), stored in the order of the grams, so a search reads the row groups of its own grams alone; a gram that most records
hold is spread over several files. Records that have all grams of a word are candidates, and the word is then looked for in
their text, so the answer is that of reading every record. A word of one or two characters is a gram itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored

# The fields that a search reads, in order, and the order of roles in its answer.
FIELDS = ("id", "title", "role_label", "subgroup_label", "journal", "source_title", "doi", "year", "branch_member_role")
ROLES = ("root", "trunk", "branch", "leaf", "fruit")
GRAM = 3


def haystack(records: DataFrame, fields: Sequence[str] = FIELDS) -> Column:
    """The fields as one lower-case text; missing columns and nulls are empty."""
    have = set(records.columns)
    return F.lower(F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("") for c in fields)), " "))


def matches(records: DataFrame, query: str, role: str | None = None, subgroup: str | None = None) -> Column:
    """Whether a record with its ``haystack`` answers a query: any role and subgroup if none is given, any text if the query is empty."""
    found = F.col("haystack").contains(F.lower(F.lit(query))) if query else F.lit(True)
    for column, wanted in (("role", role), ("subgroup", subgroup)):
        found = found & F.coalesce(F.col(column) == wanted, F.lit(False)) if wanted else found
    return found


def ranked(found: DataFrame) -> DataFrame:
    """Adds rank: by role, newest first, then by id. Roles that aren't listed come last."""
    place = F.array_position(F.array(*(F.lit(r) for r in ROLES)), F.coalesce("role", F.lit("")))
    order = W.orderBy(F.when(place > 0, place).otherwise(len(ROLES) + 1), F.coalesce(F.col("year").cast("int"), F.lit(0)).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long"))  # over what a search found


class Index:
    """The stored index of records: id, role, subgroup, year and any of the fields."""

    def __init__(self, records: DataFrame, fields: Sequence[str] = FIELDS):
        self.records = stored(records.select(F.monotonically_increasing_id().alias("n"), "*", haystack(records, fields).alias("haystack")), "records")
        text, size = F.col("haystack"), F.length("haystack")
        grams = [F.when(size >= k, F.transform(F.sequence(F.lit(1), size - k + 1), _gram(text, k))).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1)]
        postings = self.records.select(F.explode(F.array_distinct(F.concat(*grams))).alias("gram"), "n")
        self.postings = stored(postings.repartitionByRange("gram", "n").sortWithinPartitions("gram", "n"), "postings")

    def candidates(self, query: str) -> DataFrame:
        """The records that hold every gram of the query."""
        word = self.records.sparkSession.range(1).select(F.lower(F.lit(query))).first()[0]
        grams = sorted({word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))})
        have = self.postings.filter(F.col("gram").isin(grams)).groupBy("n").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == len(grams))
        return self.records.join(have.select("n"), "n")

    def search(self, query: str = "", role: str | None = None, subgroup: str | None = None) -> DataFrame:
        """The records that a query and the filters leave, with their rank."""
        rows = self.candidates(query) if query else self.records
        return ranked(rows.filter(matches(rows, query, role, subgroup))).drop("n", "haystack")


def _gram(text: Column, k: int):
    return lambda i: F.substr(text, i, F.lit(k))
