"""The cutter for single sentences and for DataFrame columns."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import charclass
from .operators import segment as S
from .sources.files import read_lexicon


@cache
def _patterns() -> tuple[re.Pattern, re.Pattern]:
    token = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", charclass.PRETOKEN.replace("(?s)", ""))
    return re.compile(token, re.S), re.compile(charclass.python_class(charclass.HAN))


def cut_text(text: str | None, paths: S.Paths) -> list[str] | None:
    """The words of one text, where paths cuts runs; without Spark."""
    if text is None:
        return None
    token, han = _patterns()
    text = re.sub(" +", charclass.SPACE_MARK, text.lstrip(" ")).removesuffix(charclass.SPACE_MARK)
    tokens = [m[0] for m in token.finditer(text)]
    cuts = iter(paths([t for t in tokens if han.match(t)]))
    return [w for t in tokens for w in (next(cuts) if han.match(t) else [t])]


class Cutter:
    """Cuts sentences with a lexicon file (word TAB freq) or a (word, freq) DataFrame.

    Single sentences are cut in this process, columns on the cluster.
    """

    def __init__(self, spark: SparkSession, lexicon: str | DataFrame):
        self.spark = spark
        self.lexicon = read_lexicon(spark, lexicon) if isinstance(lexicon, str) else lexicon
        model = S.Model(self.lexicon)
        self._paths = S.row_paths(spark, model)
        self._cut = S.cut_udf(spark, model)

    def column(self, text):
        return self._cut(text)

    def cut(self, sentence: str) -> list[str]:
        return cut_text(sentence, self._paths) or []

    def cut_df(self, df: DataFrame, text_col: str = "text", tokens_col: str = "tokens") -> DataFrame:
        return df.withColumn(tokens_col, self.column(F.col(text_col)))

    def register(self, name: str = "cut_words") -> None:
        """Make the cutter a SQL function over texts."""
        paths = self._paths

        @F.pandas_udf("array<string>")
        def whole(texts):
            return texts.map(lambda text: cut_text(text, paths))

        self.spark.udf.register(name, whole)
