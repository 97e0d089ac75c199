"""Text to padded sub-word ids as one fitted pipeline stage.

The stage holds its vocabulary, saves it with the pipeline, and works row by row with built-in
expressions, so that a table and a stream get equal ids and no row is moved.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelmill.functions.text import fold_marks, words, words_and_marks
from labelmill.operators.piece_trie import MAX_LETTERS, PieceTrie, build
from labelmill.operators.tokens import MAX_LENGTH, RESERVED
from labelmill.sources.vocabulary import read_vocabulary


class _EncoderParams(HasInputCol, HasOutputCol):
    maskCol = Param(Params._dummy(), "maskCol", "column of the attention mask", TypeConverters.toString)
    maxLength = Param(Params._dummy(), "maxLength", "positions, both ends included", TypeConverters.toInt)
    padding = Param(Params._dummy(), "padding", "pad each row to maxLength", TypeConverters.toBoolean)
    marks = Param(Params._dummy(), "marks", "keep other visible characters as tokens", TypeConverters.toBoolean)
    folding = Param(Params._dummy(), "folding", "drop accents before looking up", TypeConverters.toBoolean)
    maxWordChars = Param(Params._dummy(), "maxWordChars", "longer words are unknown; 0: no limit", TypeConverters.toInt)

    def _defaults(self) -> None:
        self._setDefault(
            inputCol="text", outputCol="input_ids", maskCol="attention_mask", maxLength=MAX_LENGTH,
            padding=True, marks=True, folding=False, maxWordChars=0,
        )


class SubwordEncoder(Estimator, _EncoderParams, DefaultParamsWriter, DefaultParamsReader):
    """Reads the vocabulary at ``vocabularyPath`` (a piece a line, its number is the id); ``fit`` looks at no row."""

    vocabularyPath = Param(Params._dummy(), "vocabularyPath", "text file(s), a piece a line", TypeConverters.toString)

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._defaults()
        self._set(**kwargs)

    def _fit(self, dataset: DataFrame) -> SubwordEncoderModel:
        vocab = read_vocabulary(dataset.sparkSession, self.getOrDefault(self.vocabularyPath))
        return self._copyValues(encoder(vocab))


class SubwordEncoderModel(Model, _EncoderParams, MLWritable, MLReadable):
    """[CLS], the pieces of the words, [SEP]; a word that cannot be spelled is [UNK]."""

    def __init__(self, vocabulary: list[tuple[str, int]] | None = None):
        super().__init__()
        self._defaults()
        self.vocabulary = sorted(vocabulary or [])
        self._trie: PieceTrie | None = None

    @property
    def trie(self) -> PieceTrie:
        if self._trie is None:
            specials = set(RESERVED)
            self._trie = build([(p, i) for p, i in self.vocabulary if p not in specials])
            if self._trie is None:
                raise ValueError("the vocabulary is too large for one trie")
        return self._trie

    def special(self, name: str) -> int:
        """Id of a reserved token: its line in the vocabulary, else its place among the reserved ones."""
        return dict(self.vocabulary).get(name, RESERVED.index(name))

    def ids(self, text: Column) -> Column:
        """The ids of a text, not yet padded."""
        pad, unk, cls, sep = (F.lit(self.special(t)).cast("int") for t in RESERVED)
        length, longest = self.getOrDefault(self.maxLength), self.getOrDefault(self.maxWordChars)
        text = F.coalesce(text, F.lit(""))
        text = fold_marks(F.lower(text)) if self.getOrDefault(self.folding) else text
        tokens = words_and_marks(text) if self.getOrDefault(self.marks) else words(text)
        tokens = F.slice(tokens, 1, length - 2)  # a word has at least one id
        if longest:
            tokens = F.transform(tokens, lambda w: F.when(F.length(w) <= longest, w))
        spelled = F.transform(self.trie.walk(tokens), lambda s: F.coalesce(self.trie.piece_ids(s), F.array(unk)))
        return F.concat(F.array(cls), F.slice(F.flatten(spelled), 1, length - 2), F.array(sep))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, mask = self.getOrDefault(self.outputCol), self.getOrDefault(self.maskCol)
        length = self.getOrDefault(self.maxLength)
        encoded = dataset.withColumn(out, self.ids(F.col(self.getOrDefault(self.inputCol))))
        real = F.array_repeat(F.lit(1), F.size(out))
        if not self.getOrDefault(self.padding):
            return encoded.withColumn(mask, real)
        gap = F.lit(length) - F.size(out)
        padded = F.concat(F.col(out), F.array_repeat(F.lit(self.special(RESERVED[0])).cast("int"), gap))
        return encoded.withColumn(mask, F.concat(real, F.array_repeat(F.lit(0), gap))).withColumn(out, padded)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    """The stage's parameters as Spark writes them, and its vocabulary beside them as Parquet."""

    def __init__(self, model: SubwordEncoderModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        rows = self.sparkSession.createDataFrame(self.model.vocabulary, "piece string, token_id int")
        rows.coalesce(1).write.parquet(f"{path}/vocabulary")


class _Reader(MLReader):
    def __init__(self, cls: type):
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SubwordEncoderModel:
        rows = self.sparkSession.read.parquet(f"{path}/vocabulary").collect()
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.cls([(r["piece"], r["token_id"]) for r in rows])
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def encoder(vocab: DataFrame, **params) -> SubwordEncoderModel:
    """The stage for a table ``vocab(piece, token_id)``, whose size is checked; a blank piece is no piece."""
    if (vocab.agg(F.sum(F.length("piece"))).first()[0] or 0) > MAX_LETTERS:
        raise ValueError(f"the pieces have more than {MAX_LETTERS} letters")
    rows = vocab.where("piece <> ''").select("piece", "token_id").collect()
    return SubwordEncoderModel([(r["piece"], r["token_id"]) for r in rows])._set(**params)
