"""Functions on commit attributes: identity, parents, change flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMIT_JSON = T.StructType(
    [
        T.StructField("sha", T.StringType()),
        T.StructField(
            "commit",
            T.StructType(
                [
                    T.StructField(
                        "author",
                        T.StructType(
                            [
                                T.StructField("name", T.StringType()),
                                T.StructField("email", T.StringType()),
                                T.StructField("date", T.StringType()),
                            ]
                        ),
                    )
                ]
            ),
        ),
        T.StructField("author", T.StructType([T.StructField("login", T.StringType())])),
        T.StructField(
            "parents", T.ArrayType(T.StructType([T.StructField("sha", T.StringType())]))
        ),
    ]
)


def same_author(
    id_a: Column, id_b: Column, name_a: Column, name_b: Column, emails_a: Column, emails_b: Column
) -> Column:
    """Same id, same full name or a shared e-mail; missing values never match."""
    return F.coalesce(
        F.coalesce(id_a == id_b, F.lit(False))
        | F.coalesce(name_a == name_b, F.lit(False))
        | F.coalesce(F.arrays_overlap(emails_a, emails_b), F.lit(False)),
        F.lit(False),
    )


def is_merge(parents: Column) -> Column:
    """More than one parent; octopus merges included."""
    return F.coalesce(F.size(parents), F.lit(0)) > 1


def commit_facts(document: Column) -> Column:
    """Commit JSON to ``sha, login, name, email, authored_at, parents``; no login gives ''."""
    doc = F.from_json(document, COMMIT_JSON)
    return F.struct(
        doc["sha"].alias("sha"),
        F.coalesce(doc["author"]["login"], F.lit("")).alias("login"),
        doc["commit"]["author"]["name"].alias("name"),
        doc["commit"]["author"]["email"].alias("email"),
        doc["commit"]["author"]["date"].alias("authored_at"),
        F.transform(doc["parents"], lambda p: p["sha"]).alias("parents"),
    )


def is_readme(filename: Column) -> Column:
    return F.lower(filename).contains("readme")


def is_config(filename: Column) -> Column:
    return F.lower(filename).contains("config")


def change_flags(filename: Column, status: Column, added: Column, deleted: Column) -> list[Column]:
    """One-hot change type (A, C, D, M, R) and the lines counted per kind of change."""
    zero = F.lit(0)
    return [(status == s).cast("int").alias(f"is_{s.lower()}") for s in "ACDMR"] + [
        F.when(status == "A", added).otherwise(zero).alias("lines_in_added_files"),
        F.when(status == "M", added).otherwise(zero).alias("lines_in_modified_files"),
        deleted.alias("lines_deleted"),
        F.when(is_readme(filename), added).otherwise(zero).alias("readme_lines_added"),
        is_config(filename).alias("about_config"),
    ]
