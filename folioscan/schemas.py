"""Row types of the stored tables."""

from pyspark.sql import types as T

_S, _I = T.StringType(), T.IntegerType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in fields.items()])


BLOCK = _struct(id=_S, kind=_S, section=_S, text=_S, narrative=T.BooleanType())
BLOCK_STATISTICS = _struct(block_id=_S, kind=_S, section=_S, characters=_I, words=_I, sentences=_I, narrative=T.BooleanType())
STATISTICS = _struct(characters=_I, characters_no_whitespace=_I, words=_I, sentences=_I, blocks=T.ArrayType(BLOCK_STATISTICS))
#: An article: identity, bibliographic fields ("" where unknown), text blocks and where it came from.
DOCUMENT = _struct(
    pmcid=_S, title=_S, blocks=T.ArrayType(BLOCK), pmid=_S, doi=_S, year=_S, language=_S, license=_S, license_url=_S, source_url=_S, acquired_at=_S, raw_path=_S, sha256=_S,
    back_blocks=T.ArrayType(BLOCK), statistics=STATISTICS, content_scope=_S,
)
TOMBSTONE = _struct(pmcid=_S, document=DOCUMENT, deleted_at=_S, reason=_S)
MANIFEST = _struct(pmcid=_S, pmid=_S, status=_S, reason=_S, source_url=_S, raw_path=_S, acquired_at=_S, imported_at=_S, sha256=_S, license=_S, license_url=_S, language=_S, content_scope=_S)
SELECTION = _struct(pmid=_S, raw_file=_S, status=_S, reason=_S, duplicate_records=_I, languages=T.ArrayType(_S))
#: What parsing an XML file gives for each article, or for the file if it can't be read: error is "" or says why.
PARSED = _struct(raw_path=_S, sha256=_S, article_no=_I, error=_S, deleted_record=T.BooleanType(), document=DOCUMENT)
