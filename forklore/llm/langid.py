"""Language identification by compression: the language whose dictionary shortens a text most."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"


@dataclass
class Languages:
    """Raw-content dictionaries by language.

    A longer dictionary shortens any text more. So languages are compared at equal length: those with the longest
    dictionary first, then each shorter one against the best so far, whose dictionary is cut to the same length. A shorter
    one that shortens the text no more than none would does not count.

    A text is compressed in blocks of ``block`` bytes, each alone, so that the dictionary and not the
    text's own beginning is what helps; all blocks count. Letters are lower-cased.
    """

    dictionaries: dict[str, bytes]
    block: int = 1024
    level: int = 9
    _tools: list = field(default_factory=list, repr=False)

    def __getstate__(self):
        return {"dictionaries": self.dictionaries, "block": self.block, "level": self.level, "_tools": []}

    def __setstate__(self, state):
        self.__dict__.update(state)

    def _compressor(self, name: str, length: int):
        held = zstandard.ZstdCompressionDict(self.dictionaries[name][-length:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=self.level)
        return zstandard.ZstdCompressor(
            level=self.level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False
        ).compress

    def _plain(self):
        return zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False).compress

    def _compressors(self) -> list:
        """(length, {language: compress}, compress without a dictionary) by falling length; a language is in the groups of its own length and of all below."""
        if not self._tools:
            for length in sorted({len(d) for d in self.dictionaries.values()}, reverse=True):
                fit = [n for n, d in sorted(self.dictionaries.items()) if len(d) >= length]
                made = {n: self._compressor(n, length) for n in fit}
                self._tools.append((length, made, self._plain() if self._tools else None))
        return self._tools

    def classify(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin). Margin: by what part of its size the runner-up is larger, in the last comparison it won.

        The score is the share of the best language in weights that fall with the compressed size, the least share over
        the comparisons since it leads. A text that is null or has no letter is ``und`` with score 0, and so is all text if
        no language was learned.
        """
        tools = self._compressors()
        if not tools or not text or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0
        raw = text.lower().encode("utf-8", "replace")
        blocks = [raw[i : i + self.block] for i in range(0, len(raw), self.block)]
        best, score, margin = None, 1.0, 1.0
        for length, compress, plain in tools:
            names = [n for n in compress if n == best or len(self.dictionaries[n]) == length]
            sizes = np.array([sum(len(compress[n](b)) for b in blocks) for n in names], float)
            lead = int(np.argmin(sizes))
            if best is not None and names[lead] != best:
                held = sizes[names.index(best)]
                # it has to help by more than the noise of small dictionaries
                if sizes[lead] == held or sizes[lead] > 0.99 * sum(len(plain(b)) for b in blocks):
                    lead = names.index(best)
            if len(sizes) > 1:
                second = float(np.delete(sizes, lead).min())
                share = float(1 / np.exp(-40.0 * (sizes - sizes[lead]) / sizes[lead]).clip(0, 1).sum())
                ahead = max(0.0, float(1 - sizes[lead] / second))
                same = names[lead] == best
                score, margin = (min(score, share), min(margin, ahead)) if same else (share, ahead)
            best = names[lead]
        return best, score, margin

    def many(self, texts: Iterable[str | None]) -> pd.DataFrame:
        return pd.DataFrame(
            [self.classify(t) for t in texts], columns=["lang_pred", "score", "margin"]
        )


def held_out(doc_id: Column) -> Column:
    """True for rows that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def learn(
    docs: DataFrame, per_language: int = 64, max_chars: int = 4000, size: int = 65536, least: int = 256, **options
) -> Languages:
    """Dictionaries of at most ``size`` bytes, from at most ``per_language`` documents a language.

    Only rows that are not held out, with a language and a text, picked by hash. Of a text beyond ``max_chars`` characters a
    piece of that length is taken, from a place drawn by its hash. Each language has a dictionary of its own length, however
    short those of others are; one with a sample of fewer than ``least`` bytes in all is too little known to be predicted,
    unless no language has more.
    """
    usable = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text").where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.char_length("text") > 0)
    ).select("lang", "text", F.xxhash64("text").alias("h"))
    # picked by hash alone, each text once however often it is there; then the few texts are fetched
    first = Window.partitionBy("lang").orderBy("h")
    picked = usable.select("lang", "h").distinct().withColumn("nth", F.row_number().over(first))
    picked = picked.where(F.col("nth") <= per_language)
    spare = F.greatest(F.char_length("text") - max_chars, F.lit(0))
    piece = F.substr("text", F.pmod(F.col("h"), spare + 1).cast("int") + 1, F.lit(max_chars))
    rows = usable.join(F.broadcast(picked), ["lang", "h"]).groupBy("lang", "nth").agg(F.min(piece).alias("text"))
    texts: dict[str, list[str]] = {}
    for row in sorted(rows.collect(), key=lambda r: r["nth"]):
        texts.setdefault(row["lang"], []).append(row["text"])
    joined = {lang: "\n".join(found).lower().encode("utf-8", "replace")[-size:] for lang, found in texts.items()}
    # samples of about one length are cut to it, so that they are compared at once
    near = [len(raw) for raw in joined.values() if len(raw) >= size // 2]
    if near:
        joined = {lang: raw[-min(near) :] for lang, raw in joined.items()}
    enough = {lang: raw for lang, raw in joined.items() if len(raw) >= least}
    return Languages({lang: raw for lang, raw in (enough or joined).items() if len(raw) >= 8}, **options)


def identify(docs: DataFrame, margin: float = 0.01, **options) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row of ``docs``; whole texts are read.

    ``rejected`` marks predictions whose margin is below ``margin``, and ``und``. Null texts and texts without a letter
    are ``und`` with score 0. Rows without a doc_id are held out. Repeated rows are predicted
    alike. An empty table gives an empty result; without any language to learn all is ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, **options))

    @F.pandas_udf("lang_pred string, score double, margin double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.many(texts)

    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return found.select(
        "doc_id", "held_out", "p.lang_pred", "p.score", (F.col("p.margin") < margin).alias("rejected")
    )
