"""Text functions: names, urls, references in comments, keyword tests.

All are built-in expressions except :func:`ascii_fold`, because Spark has no
Unicode decomposition.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that must match the same texts as the studied tool.
PR_REFERENCE = r"(#|http(s)?://github.com/([\w\.-]+/){2}(pull|issues)(#(\w)+)?/)(\d+)"
PR_REFERENCE_NUMBER_GROUP = 7
ISSUE_COMMENT_REFERENCE = PR_REFERENCE + "#issuecomment-"
PUBLISHED_ISSUE_LINK = r"#([1-9][\d]{1,4})([^0-9]|$)"
COMMIT_SHA = r"\b[0-9a-f]{7} |\b[0-9a-f]{40}\b"
DUPLICATE_PR_STRICT = (
    r"(clos(e|ed|ing)|dup(licate(d)?|e)?|super(c|s)ee?ded?|obsoleted?|replaced?|redundant"
    r"|better (implementation|solution)|solved|fixed|done|going|addressed|already)[ ]{1,}"
    r"(by|in|with|as|of|in favor of|at|since|via)?[ ]{1,}" + PR_REFERENCE,
    PR_REFERENCE + r".{1,}(better (implementation|solution)|dup(licate(d)?|e)?"
    r"|(fixe(d|s)?|obsolete(d|s)?|replace(d|s)?))",
    r"dup(?:licated?)?:?[ ]{1,}" + PR_REFERENCE,
)
DUPLICATE_COMMENT_LOOSE = (
    r"(dup(licate(d)?|e)?|super(c|s)(ee)?(ded)?(edes)?|obsoleted?|replaced?|redundant"
    r"|better (implementation|solution)|solved|going|addressed|already)[ ]{1,}"
    r"(by|in|with|as|of|in favor of|at|since|via)?",
    r"(better (implementation|solution)|dup(licate(d)?|e)?|obsolete(d|s)?|replace(d|s)?)",
    r"dup(?:licated?)?:?[ ]{1,}",
)
MERGE_KEYWORDS_TYPE_4 = (
    r"(merg|apply|appl|pull|push|integrat|land|cherry(-|\s+)pick|squash)(ing|i?ed)"
)
MERGE_KEYWORDS_BROAD = (
    r"(merg|apply|appl|pull|push|integrat|land|cherry(-|\s+)pick|squash|fix)(ing|i?ed)",
    r"fix(es|ed)",
    r"done",
    r"clos(e|ed|ing)",
)

#: A link to an issue of any number.
ISSUE_LINK = r"#([1-9]\d*)(?:[^0-9]|$)"


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def ascii_fold(text: Column) -> Column:
    """Decompose accented letters (NFD) and drop what is not ASCII."""

    @F.pandas_udf("string")
    def decompose(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFD", t))

    return F.regexp_replace(decompose(text), r"[^\x00-\x7F]", "")


def strip_brackets(text: Column) -> Column:
    """Remove square brackets and line ends of a printed list."""
    return F.regexp_replace(text, r"[\[\]\n]", "")


def parse_sha_cell(cell: Column) -> Column:
    """``[a/ b/ c]`` to an array; an empty cell gives an empty array."""
    return F.filter(F.split(F.regexp_replace(cell, r"[\[\]]", ""), "/ "), lambda x: x != "")


def fork_url_canonical(url: Column) -> Column:
    """``login:branch/repo`` to ``login/repo``; anything else unchanged."""
    login = F.substring_index(url, ":", 1)
    repo = F.substring_index(url, "/", -1)
    return F.when(url.contains(":"), F.concat_ws("/", login, repo)).otherwise(url)


def url_owner(url: Column) -> Column:
    return F.split_part(url, F.lit("/"), F.lit(1))


def url_repo(url: Column) -> Column:
    return F.split_part(url, F.lit("/"), F.lit(2))


def url_as_file_name(url: Column, separator: str = ".") -> Column:
    """``owner/repo`` as used in export file names (``.`` or ``~``)."""
    return F.replace(url, F.lit("/"), F.lit(separator))


def strip_api_prefix(url: Column) -> Column:
    """Drop the REST prefix so that only ``owner/repo`` is left."""
    return F.regexp_replace(url, r"^https://api\.github\.com/repos/", "")


def unordered_pair_key(a: Column, b: Column) -> Column:
    """One key for ``(a, b)`` and ``(b, a)``."""
    return F.concat_ws(",", F.least(a, b), F.greatest(a, b))


def name_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of the lower-cased names."""
    return F.levenshtein(F.lower(a), F.lower(b))


def names_differ(a: Column, b: Column, threshold: int = 2) -> Column:
    return name_distance(a, b) > threshold


def is_duplicate_pr_text(text: Column) -> Column:
    """Text calls the pull request a duplicate and names the other one."""
    return _any([text.rlike(p) for p in DUPLICATE_PR_STRICT])


def is_duplicate_comment(text: Column) -> Column:
    """Text sounds like a duplicate notice, reference or not."""
    return _any([text.rlike(p) for p in DUPLICATE_COMMENT_LOOSE])


def referenced_numbers(text: Column) -> Column:
    """Distinct pull request / issue numbers named by ``#n`` or by url."""
    found = F.regexp_extract_all(text, F.lit(PR_REFERENCE), F.lit(PR_REFERENCE_NUMBER_GROUP))
    return F.array_distinct(F.transform(found, lambda n: n.try_cast("bigint")))


def issue_links(text: Column, published: bool = False) -> Column:
    """Distinct ``#n`` links; with ``published`` only those of two to five digits."""
    found = F.regexp_extract_all(text, F.lit(PUBLISHED_ISSUE_LINK if published else ISSUE_LINK), F.lit(1))
    return F.array_compact(F.array_distinct(F.transform(found, lambda n: n.try_cast("bigint"))))


def commit_sha_mention(text: Column) -> Column:
    """First commit hash in the text (7 hex and a blank, or 40 hex), else NULL."""
    return F.nullif(F.trim(F.regexp_extract(text, COMMIT_SHA, 0)), F.lit(""))


def names_other_pr(text: Column) -> Column:
    """A pull request is named, other than by a link to a comment of that very link."""
    low = F.lower(text)
    link = F.regexp_extract(low, PR_REFERENCE, 0)
    comment_link = F.regexp_extract(low, ISSUE_COMMENT_REFERENCE, 0)
    plain = F.replace(link, F.lit("#"), F.lit(""))
    return (link != "") & ((comment_link == "") | ~comment_link.contains(plain))


def has_merge_keyword(text: Column) -> Column:
    return F.lower(text).rlike(MERGE_KEYWORDS_TYPE_4)


def has_broad_merge_keyword(text: Column) -> Column:
    return _any([F.lower(text).rlike(p) for p in MERGE_KEYWORDS_BROAD])


def digits_only_id(text: Column) -> Column:
    """All digits of the text read as one number, NULL if there are none."""
    return F.regexp_replace(text, r"\D+", "").try_cast("bigint")


def owner_login_repaired(login: Column, url: Column) -> Column:
    """The login, or the owner in the url where the login is unusable."""
    bad = login.isNull() | login.isin("", "null") | login.contains("/")
    return F.when(bad, url_owner(url)).otherwise(login)


def same_description(a: Column, b: Column) -> Column:
    return F.coalesce(F.trim(a) == F.trim(b), F.lit(False))


def ends_with_any(text: Column, suffixes: Sequence[str]) -> Column:
    """Lower-cased text ends with one of the suffixes."""
    low = F.lower(text)
    return _any([low.endswith(s) for s in suffixes])


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """Lower-cased text contains one of the words (also lower-cased)."""
    low = F.lower(text)
    return _any([low.contains(w.lower()) for w in words])
