"""Surrogates for personal data: keyed, of the same kind and format, distinct, and the same everywhere.

Everything runs as Spark expressions. One pattern finds all mentions. A mention refers to one
entity (an e-mail address, a number) or two (given and family name). Each distinct entity of the corpus gets a
surrogate from a keyed hash; entities whose surrogate is taken, or is the value of a
real entity, draw again until all differ. Mentions are rewritten with the surrogates of their entities in their own format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forklore.session import materialize, materialize_counted

TITLES_MALE = ["Mr", "Herr", "Señor", "Monsieur", "господин", "г-н"]
TITLES_FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "госпожа", "г-жа"]
TITLES_ANY = ["Dr", "Prof"]
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: Words before a secret; between them and it stand an equals sign or a colon, spaces and quotes.
_LABELS = r"(?:password|passwd|secret|api_key|token)"

#: Kind of entity and where it stands, in order of preference. No part repeats without bound before a fixed
#: character, so long texts without a match cost linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+\.[A-Za-z0-9.-]*[A-Za-z0-9-]",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![A-Za-z0-9])",
    "secret": rf"(?<=[=:\"]|[=:] )(?<={_LABELS}[=:]|{_LABELS}(?: = |: |\": |\": \"| = \"|=\"))[A-Za-z0-9_-]{{6,}}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\w-])"
    r"|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?![\w-])|(?<![\w+-])(?:\d{1,2}[.-])?\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w-])\d(?:[ -]?\d){12,18}+(?![\w-])",
    "name": r"(?<!\p{L})(?:" + "|".join(TITLES_FEMALE + TITLES_MALE + TITLES_ANY)
    + r")\.? \p{Lu}\p{Ll}{1,30}+(?: \p{Lu}\p{Ll}{1,30}+)?(?!\p{L})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
_LATIN = "ba be bo da de do fa fe ga ka ke la le lo ma me mi mo na ne ni no pa ra re ri ro sa se so ta te ti to va ve vi za zo"
_CYRILLIC = "ба бе бо ва ве ви га да де до жа за зо ка ке ко ла ле ли ло ма ме ми на не ни но па по ра ре ро са се со та те ти"


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _kind(mention: Column) -> Column:
    """The first kind whose pattern is the whole mention; cards only with a right check digit.

    What fits no pattern alone was found by the word before it, and is a secret.
    """
    kind = F.when(~mention.rlike(f"^(?:{PATTERNS['card']})$"), "secret")
    for name, pattern in reversed(PATTERNS.items()):
        if name == "secret":
            continue
        fits = mention.rlike(f"^(?:{pattern})$")
        if name == "card":
            fits = fits & _luhn(F.regexp_replace(mention, "[ -]", ""))
        kind = F.when(fits, name).otherwise(kind)
    return kind


def _entities(mention: Column, kind: Column) -> Column:
    """The entities of a mention, as an array of (kind, value, gender); the gender is what a title tells of a given name."""
    digits = F.regexp_replace(mention, r"\D", "")
    value = (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.replace(mention, F.lit(" "), F.lit("")))
        .otherwise(mention)
    )
    titled = lambda titles: mention.rlike("^(?:" + "|".join(titles) + r")\.? ")
    gender = F.when(titled(TITLES_FEMALE), "f").when(titled(TITLES_MALE), "m").otherwise("n")
    words = F.slice(F.split(mention, " "), 2, 2)
    no = F.lit("n").alias("gender")
    family = F.struct(F.lit("family").alias("kind"), F.element_at(words, -1).alias("value"), no)
    given = F.struct(F.lit("given").alias("kind"), F.element_at(words, 1).alias("value"), gender.alias("gender"))
    named = F.when(F.size(words) == 2, F.array(given, family)).otherwise(F.array(family))
    one = F.array(F.struct(kind.alias("kind"), value.alias("value"), no))
    return F.when(kind == "name", named).otherwise(one)


def _draw(secret: str, kind: Column, value: Column, attempt: int) -> Column:
    """256 hex digits that depend on key, entity and attempt."""
    seed = F.concat_ws("\x1f", F.lit(secret), kind, value, F.lit(str(attempt)))
    return F.concat(*[F.sha2(F.concat_ws("\x1f", seed, F.lit(str(i))), 256) for i in range(4)])


def _number(hexes: Column, at: Column | int, digits: int = 2) -> Column:
    start = at * digits + 1 if isinstance(at, int) else F.pmod(at * digits, F.lit(256 - digits)) + 1
    return F.conv(F.substr(hexes, F.lit(start) if isinstance(start, int) else start, F.lit(digits)), 16, 10).cast("int")


def _pick(letters: str, number: Column) -> Column:
    return F.substr(F.lit(letters), F.pmod(number, F.lit(len(letters))) + 1, F.lit(1))


def _like(value: Column, hexes: Column, lower: str = "abcdefghijklmnopqrstuvwxyz", keep: int = 0) -> Column:
    """Every letter and digit drawn anew within its class, except the first ``keep``."""

    def drawn(c: Column, i: Column) -> Column:
        n = _number(hexes, i)
        changed = (
            F.when(c.rlike("[0-9]"), _pick("0123456789", n))
            .when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike("[a-z]"), _pick(lower, n))
            .otherwise(c)
        )
        return F.when(i < keep, c).otherwise(changed)

    return F.array_join(F.transform(F.split(value, ""), drawn), "")


def _name(hexes: Column, kind: Column, value: Column, attempt: int) -> Column:
    """Syllables in the script of the value, one more with each attempt; a given name ends as its gender does."""

    def spelled(syllables: str, male: str, female: str) -> Column:
        all_ = F.array(*[F.lit(s) for s in syllables.split()])
        parts = [F.get(all_, F.pmod(_number(hexes, i, 4), F.lit(len(syllables.split())))) for i in range(3 + attempt)]
        end = F.when(kind == "given_m", male).when(kind == "given_f", female).otherwise("")
        return F.initcap(F.concat(*parts, end))

    return F.when(value.rlike(r"^\p{IsCyrillic}"), spelled(_CYRILLIC, "н", "я")).otherwise(spelled(_LATIN, "n", "a"))


def _secret(hexes: Column, value: Column, attempt: int) -> Column:
    """A secret of the same length and classes; from the eighth attempt on longer, for those of few or no letters and digits."""
    return F.concat(_like(value, hexes), *_more(hexes, attempt))


def _more(hexes: Column, attempt: int) -> list[Column]:
    return [_pick("abcdefghijklmnopqrstuvwxyz", _number(hexes, 64 + i)) for i in range(attempt // 8)]


def surrogate(kind: Column, value: Column, hexes: Column, attempt: int = 0) -> Column:
    """The value that stands for an entity, made from what :func:`_draw` drew for it in this attempt.

    Names, secrets and addresses grow with the attempts, so that their number is not bounded by three syllables or a short format.
    """
    # a country code and an issuer's leading digit are kept, and a card's check digit is right again
    phone = _like(value, hexes, keep=1)
    card = F.substr(_like(value, hexes, keep=1), F.lit(1), F.char_length(value) - 1)
    check = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.concat(card, d.cast("string"))), _luhn)
    octets = [_number(hexes, i) for i in range(4)]
    ip = F.concat_ws(".", *[(F.pmod(o, F.lit(223 if i == 0 else 254)) + 1).cast("string") for i, o in enumerate(octets)])
    return (
        F.when(kind == "card", F.get(check, F.lit(0)))
        .when(kind == "phone", phone)
        .when(kind == "ip", ip)
        .when(kind == "key", _like(value, hexes, keep=4))
        .when(kind == "token", _like(value, hexes, lower="abcdef"))
        .when(kind == "iban", _like(value, hexes, keep=2))
        .when(kind == "email", F.concat(_like(F.substring_index(value, "@", 1), hexes), *_more(hexes, attempt), F.lit("@"), _host(value, hexes)))
        .when(kind.isin("ssn"), _like(value, hexes))
        .when(kind == "secret", _secret(hexes, value, attempt))
        .otherwise(_name(hexes, kind, value, attempt))
    )


def _host(value: Column, hexes: Column) -> Column:
    """The host drawn anew but for its last two labels' shape: they are the reserved example.org."""
    host = F.substring_index(value, "@", -1)
    labels = F.split(host, r"\.")
    front = F.array_join(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(1))), ".")
    return F.concat(_like(front, F.reverse(hexes)), F.lit(".example.org"))


def assign(entities: DataFrame, secret: str, rounds: int = 40) -> DataFrame:
    """(kind, value, surrogate): one row per distinct entity, all surrogates of a kind distinct.

    No surrogate is the value of an entity of its kind. Those that are taken draw again. A kind whose format has fewer values than
    the corpus has entities cannot be kept distinct and raises an error.
    """
    todo = entities.select("kind", "value").distinct()
    todo = materialize(todo, "entities")
    known = todo.select("kind", F.col("value").alias("surrogate"))
    done = None
    for attempt in range(rounds):
        kind, value = F.col("kind"), F.col("value")
        drawn = todo.withColumn("drawn", _draw(secret, kind, value, attempt))
        drawn = drawn.withColumn("surrogate", surrogate(kind, value, F.col("drawn"), attempt))
        turn = Window.partitionBy("kind", "surrogate").orderBy(F.xxhash64("value"), "value")
        taken = known.select("kind", "surrogate", F.lit(True).alias("taken")).distinct()
        judged = drawn.withColumn("turn", F.row_number().over(turn)).join(taken, ["kind", "surrogate"], "left")
        fine = F.col("taken").isNull() & (F.col("turn") == 1) & F.col("surrogate").isNotNull()
        judged, again = materialize_counted(
            judged.select("kind", "value", "surrogate", fine.alias("fine")), "surrogates", ~F.col("fine")
        )
        good = judged.where("fine").select("kind", "value", "surrogate")
        done = good if done is None else done.unionByName(good)
        if not again:
            return done
        known = known.unionByName(good.select("kind", "surrogate"))
        todo = judged.where(~F.col("fine")).select("kind", "value")
    raise RuntimeError(f"{again} entities have no surrogate of their own after {rounds} rounds")


def _rewritten(mention: Column, kind: Column, stand_ins: Column) -> Column:
    """A mention with its entities' surrogates, in its own format."""
    first, last = F.element_at(stand_ins, 1), F.element_at(stand_ins, -1)
    upper = mention == F.upper(mention)

    def filled(c: Column, i: Column) -> Column:
        before = F.char_length(F.regexp_replace(F.substr(mention, F.lit(1), i), r"\D", ""))
        return F.when(c.rlike("[0-9]"), F.substr(first, before + 1, F.lit(1))).otherwise(c)

    def spaced(c: Column, i: Column) -> Column:
        before = F.char_length(F.replace(F.substr(mention, F.lit(1), i), F.lit(" "), F.lit("")))
        return F.when(c != " ", F.substr(first, before + 1, F.lit(1))).otherwise(c)

    chars = F.split(mention, "")
    named = F.concat(
        F.substring_index(mention, " ", 1), F.lit(" "), first,
        F.when(F.size(stand_ins) == 2, F.concat(F.lit(" "), last)).otherwise(""),
    )
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.array_join(F.transform(chars, filled), ""))
        .when(kind == "iban", F.array_join(F.transform(chars, spaced), ""))
        .when(kind == "name", named)
        .when((kind == "email") & upper, F.upper(first))
        .otherwise(first)
    )


def pseudonymize(docs: DataFrame, secret: str = "surrogates") -> DataFrame:
    """``row`` (the input row), ``text`` with surrogates, ``n_replaced`` and ``kinds`` (sorted set).

    ``secret`` keys the surrogates: who does not know it cannot redo them. Equal entities have equal surrogates in
    all documents. Each distinct mention is rewritten once; documents meet the result by mention, which may stand
    in any share of them (an ordinary skewed join), and get their mentions back by row.

    Null text stays null with 0 replaced; so does text without personal data, which is returned as it is. Rows that
    repeat are rewritten alike. An empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").alias("t"))
    hint = F.col("t").rlike(rf"[0-9@]| \p{{Lu}}|{_LABELS}[\" ]{{0,2}}[=:]|sk-")  # one of these stands in every mention
    found = slim.where(hint).select("d", F.xxhash64("t").alias("h"), F.regexp_extract_all("t", F.lit(ANY), F.lit(0)).alias("m"))
    found = found.where(F.size("m") > 0).distinct().select("d", "h", F.posexplode("m").alias("nth", "mention"))
    found = materialize(found, "mentions")
    each = found.select("mention").distinct().withColumn("kind", _kind(F.col("mention"))).where(F.col("kind").isNotNull())
    each = each.withColumn("entities", _entities(F.col("mention"), F.col("kind")))
    each = materialize(each, "kinds")
    parts = each.select("mention", F.posexplode("entities").alias("nth", "e"))
    # one entity whatever titles it has; f or m if any mention tells
    told = parts.groupBy("e.kind", "e.value").agg(F.min("e.gender").alias("gender"))
    sort = F.when(F.col("kind") == "given", F.concat(F.lit("given_"), "gender")).otherwise(F.col("kind"))
    names = assign(told.select(sort.alias("kind"), "value"), secret)
    names = names.select(F.regexp_replace("kind", "^given_.$", "given").alias("kind"), "value", "surrogate")
    named = parts.select("mention", "nth", "e.kind", "e.value").join(names, ["kind", "value"])
    ordered = F.array_sort(F.collect_list(F.struct("nth", "surrogate")))
    named = named.groupBy("mention").agg(F.transform(ordered, lambda x: x["surrogate"]).alias("s"))
    rewritten = each.select("mention", "kind").join(named, "mention")
    rewritten = materialize(
        rewritten.select("mention", "kind", _rewritten(F.col("mention"), F.col("kind"), F.col("s")).alias("new")), "rewritten"
    )
    met = found.join(rewritten, "mention", "left").groupBy("d", "h").agg(
        F.array_sort(F.collect_list(F.struct("nth", F.coalesce("new", "mention").alias("new")))).alias("put"),
        F.count("kind").alias("n"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
    )
    full = docs.select(F.struct("*").alias("row")).withColumn("_d", F.col("row.doc_id").cast("long"))
    full = full.withColumn("_h", F.xxhash64("row.text"))
    joined = full.join(met, F.col("_d").eqNullSafe(F.col("d")) & (F.col("_h") == F.col("h")), "left")
    gaps = F.split("row.text", ANY)
    put = F.concat(F.transform("put", lambda x: x["new"]), F.array(F.lit("")))
    new = F.array_join(F.zip_with(gaps, put, lambda g, p: F.concat(g, p)), "")
    return joined.select(
        "row",
        F.when(F.col("n") > 0, new).otherwise(F.col("row.text")).alias("text"),
        F.coalesce("n", F.lit(0)).alias("n_replaced"),
        F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"),
    )
