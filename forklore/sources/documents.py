"""JSON documents and stored search pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forklore.functions.dates import iso_timestamp, pr_state
from forklore.schemas import PR_JSON, REPOSITORY_JSON

# The class of a search hit.
SEARCH_ITEM_CLASS = "repo-list-item"


def repositories(documents: DataFrame, column: str = "document") -> DataFrame:
    """Flat repository facts from JSON; the parent is NULL for a repository that is no fork."""
    doc = F.from_json(column, REPOSITORY_JSON)
    return documents.select(doc.alias("d")).select(
        F.col("d.id").alias("repo_id"),
        F.col("d.full_name").alias("url"),
        F.col("d.fork").alias("is_fork"),
        F.col("d.forks_count").alias("forks"),
        F.col("d.stargazers_count").alias("stars"),
        F.col("d.language").alias("language"),
        iso_timestamp(F.col("d.created_at")).cast("timestamp_ntz").alias("created_at"),
        iso_timestamp(F.col("d.pushed_at")).cast("timestamp_ntz").alias("pushed_at"),
        F.col("d.owner.login").alias("owner"),
        F.col("d.owner.type").alias("owner_type"),
        F.col("d.parent.full_name").alias("parent_url"),
    )


def array_or_object(documents: DataFrame, element: T.DataType, column: str = "document"):
    """One row per object, whether the text is an array, one object, or empty."""
    text = F.trim(F.col(column))
    array = F.when(text.startswith("["), text).otherwise(
        F.concat(F.lit("["), F.nullif(text, F.lit("")), F.lit("]"))
    )
    keys = [c for c in documents.columns if c != column]
    return documents.select(
        *keys, F.explode(F.from_json(array, T.ArrayType(element))).alias("item")
    )


def pr_listing(documents: DataFrame, commits: DataFrame) -> DataFrame:
    """Pull requests of JSON listings with their state and number of commits.

    ``documents(project_id, document)``, ``commits(project_id, pr_id, sha)``.
    """
    item = F.col("item")
    prs = array_or_object(documents, PR_JSON).select(
        "project_id",
        item["number"].alias("pr_id"),
        item["user"]["login"].alias("author"),
        pr_state(item["closed_at"], item["merged_at"]).alias("state"),
    )
    sizes = commits.groupBy("project_id", "pr_id").agg(F.count_distinct("sha").alias("n_commits"))
    return prs.join(sizes, ["project_id", "pr_id"], "left").withColumn(
        "n_commits", F.coalesce("n_commits", F.lit(0))
    )


#: Elements that are never closed.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


def search_hits(
    pages: DataFrame, key: str = "page_id", html: str = "html", item_class: str = SEARCH_ITEM_CLASS
) -> DataFrame:
    """``key, position, name`` of each hit in stored search pages, parsed page by page.

    The parser is local to the function, so it travels to the executors with it.
    """
    key_type = pages.schema[key].dataType.simpleString()

    class Hits(HTMLParser):
        """Text of the first link inside each element of a class; an element without a link has none."""

        def __init__(self):
            super().__init__()
            self.found = []
            self.open, self.item, self.inside = [], None, False

        def handle_starttag(self, tag, attrs):
            given = dict(attrs)
            if item_class in (given.get("class") or "").split():
                self.item = len(self.open)
            elif tag == "a" and self.item is not None and "href" in given:
                self.item, self.inside = None, True
                self.found.append("")
            if tag not in VOID_TAGS:
                self.open.append(tag)

        def handle_endtag(self, tag):
            if tag == "a":
                self.inside = False
            if tag in self.open:
                while self.open.pop() != tag:
                    pass
            if self.item is not None and len(self.open) <= self.item:
                self.item = None

        def handle_data(self, data):
            if self.inside:
                self.found[-1] += data

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for k, text in zip(batch[key], batch[html], strict=True):
                parser = Hits()
                parser.feed(text or "")
                out += [(k, i, name.strip()) for i, name in enumerate(parser.found)]
            yield pd.DataFrame(out, columns=[key, "position", "name"])

    return pages.select(key, html).mapInPandas(parse, f"{key} {key_type}, position int, name string")


def field(document: Column, path: str) -> Column:
    return F.get_json_object(document, f"$.{path}")
