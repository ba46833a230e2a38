"""Cutting documents into bounded, overlapping passages.

Both cutters are one narrow projection per document: the text is turned into an array of
passages by array and string expressions, and only the passages leave the row. Nothing shuffles,
and the cost is linear in the length of the text.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwell.functions.text import WHITESPACE, is_blank
from groundwell.schemas import MAX_CHUNK_CHARS, OVERLAP_CHARS

# White space that ends a sentence, after one of . ! ?
SENTENCE_GAP = r"(?<=[.!?])[\t\n\x0B\f\r ]+"


def _check_limits(max_chars: int, overlap: int) -> None:
    if not 1 <= max_chars <= 8000:
        raise ValueError("max_chars must be within 1..8000")
    if not 0 <= overlap <= 4000:
        raise ValueError("overlap must be within 0..4000")
    if overlap and overlap >= max_chars - 1:
        raise ValueError("overlap must be smaller than max_chars - 1")


def _slices(text: Column, width: int) -> Column:
    """Consecutive pieces of `width` characters (one regex pass, no repeated substr)."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def _atoms(text: Column, body_max: int) -> Column:
    """Lines, with lines over the limit cut at sentence ends and then at the limit."""
    unified = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n"))
    lines = F.split(F.coalesce(unified, text), "\n")

    def cut(line: Column) -> Column:
        sentences = F.split(line, SENTENCE_GAP)
        pieces = F.transform(
            sentences,
            lambda s: F.when(F.length(s) <= body_max, F.array(s)).otherwise(_slices(s, body_max)),
        )
        return F.when(F.length(line) <= body_max, F.array(line)).otherwise(F.flatten(pieces))

    return F.filter(F.flatten(F.transform(lines, cut)), lambda atom: atom.rlike(f"[^{WHITESPACE}]"))


def _tail(body: Column, overlap: int) -> Column:
    """The last `overlap` characters, moved past a word that the cut would split."""
    tail = F.substring(body, -overlap, overlap)
    edge = F.substring(body, -overlap - 1, 2)
    mid_word = (F.length(body) > overlap) & edge.rlike(f"^[^{WHITESPACE}]{{2}}$")
    first_word = f"^[^{WHITESPACE}]*[{WHITESPACE}]"
    return F.when(mid_word, F.regexp_replace(tail, first_word, "")).otherwise(tail)


def _packed(atoms: Column, room: int) -> Column:
    """Atoms joined left to right into bodies of at most `room` characters.

    No atom is over the limit, so the greedy match that ends at a line break or at the end takes as
    many whole atoms as fit.
    """
    pattern = f"(?s)(.{{1,{room}}})(?:\n|\\z)"
    return F.regexp_extract_all(F.array_join(atoms, "\n"), F.lit(pattern), F.lit(1))


def _packed_by(measure: Callable[[Column], Column], atoms: Column, room: int) -> Column:
    """The same with lengths taken by `measure`, as a fold (which copies its state per atom)."""

    def state(body: Column, done: Column) -> Column:
        return F.struct(body.alias("body"), done.alias("done"))

    def closed(acc: Column) -> Column:
        return F.when(acc["body"].isNull(), acc["done"]).otherwise(
            F.array_append(acc["done"], acc["body"])
        )

    def pack(acc: Column, atom: Column) -> Column:
        joined = F.concat(acc["body"], F.lit("\n"), atom)
        fits = F.coalesce(measure(joined) <= room, F.lit(False))
        return F.when(fits, state(joined, acc["done"])).otherwise(state(atom, closed(acc)))

    start = state(F.lit(None).cast("string"), F.array().cast("array<string>"))
    return F.aggregate(atoms, start, pack, closed)


def boundary_chunks(
    text: Column,
    max_chars: int = MAX_CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    measure: Callable[[Column], Column] = F.length,
) -> Column:
    """TRF-1 as an expression: array of passages that keep to line and sentence boundaries.

    Lines are packed into bodies of at most `max_chars` less the room for the overlap; every
    passage but the first starts with the tail of the body before it.
    """
    _check_limits(max_chars, overlap)
    room = max_chars - overlap - 1 if overlap else max_chars
    atoms = _atoms(text, room)
    bodies = _packed(atoms, room) if measure is F.length else _packed_by(measure, atoms, room)
    if overlap == 0:
        return bodies

    def overlapped(all_bodies: Column) -> Column:
        none = F.array(F.lit(None).cast("string"))
        tails = F.concat(none, F.transform(all_bodies, lambda body: _tail(body, overlap)))
        whole = F.zip_with(
            tails,
            all_bodies,
            lambda tail, body: F.when(tail.isNull(), body).otherwise(
                F.concat(tail, F.lit("\n"), body)
            ),
        )
        return F.filter(whole, lambda chunk: chunk.isNotNull())

    # A one-element transform binds the bodies to a name, so that they are computed once.
    return F.flatten(F.transform(F.array(bodies), overlapped))


def fixed_chunks(
    text: Column, max_chars: int = MAX_CHUNK_CHARS, overlap: int = OVERLAP_CHARS
) -> Column:
    """TRF-2 as an expression: windows of `max_chars`, each `max_chars - overlap` further on.

    One regex pass: the look-ahead captures a window while the match itself moves by the step.
    Windows that would lie wholly inside the overlap of the one before are dropped.
    """
    _check_limits(max_chars, overlap)
    step = max_chars - overlap
    pattern = f"(?s)(?=(.{{1,{max_chars}}})).{{1,{step}}}"
    count = F.ceil(F.greatest(F.length(text) - overlap, F.lit(1)) / step).cast("int")
    return F.slice(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(1), count)


def _exploded(documents: DataFrame, chunks: Column, carry) -> DataFrame:
    return documents.select(*carry, F.posexplode(chunks).alias("chunk_index", "chunk_text"))


def chunk_documents(
    documents: DataFrame,
    text: str = "text",
    carry=("doc_id",),
    max_chars: int = MAX_CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
    measure: Callable[[Column], Column] = F.length,
) -> DataFrame:
    """TRF-1: one row (carried columns, chunk_index, chunk_text) per passage; blank text gives none."""
    return _exploded(
        documents, boundary_chunks(F.col(text), max_chars, overlap, measure), carry
    )


def chunk_fixed_width(
    documents: DataFrame,
    text: str = "text",
    carry=("doc_id",),
    max_chars: int = MAX_CHUNK_CHARS,
    overlap: int = OVERLAP_CHARS,
) -> DataFrame:
    """TRF-2: one row per fixed-width window; blank text gives none."""
    return _exploded(
        documents.where(~is_blank(F.col(text))), fixed_chunks(F.col(text), max_chars, overlap), carry
    )


def check_chunks(
    chunks: DataFrame,
    max_chars: int = MAX_CHUNK_CHARS,
    measure: Callable[[Column], Column] = F.length,
) -> DataFrame:
    """TRF-3, per passage: marks passages over the limit."""
    over = measure(F.col("chunk_text")) > max_chars
    return chunks.withColumn("error_code", F.when(over, "chunking.limit_exceeded"))


def documents_without_chunks(
    documents: DataFrame, chunks: DataFrame, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """TRF-3, per document: non-blank documents that no passage came from."""
    return (
        documents.where(~is_blank(F.col(text)))
        .select(key)
        .join(chunks.select(key).distinct(), key, "left_anti")
        .withColumn("error_code", F.lit("document.no_chunks_produced"))
    )
