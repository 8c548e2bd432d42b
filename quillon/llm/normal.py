"""One form for texts that look the same.

The form is the compatibility normalisation in composed form with look-alike letters, spaces and line
ends mapped and default-ignorable characters removed. Compatibility mappings that a reader can see
(raised and lowered signs, fractions, circled, squared and styled signs) are not applied, and case is
folded on request only, because texts that a reader can tell apart must stay different.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.session import Workspace

# fixed values: letters that look like a Latin letter in common fonts
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "Ζ": "Z",
    # Armenian and Latin
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "Օ": "O", "ɡ": "g", "ɑ": "a",
    # hyphens
    "‐": "-", "‑": "-",
}
# fixed values: compatibility mappings that keep the look; <wide> and <narrow> differ in width only
SAME_LOOK = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>")
# fixed values: the property Default_Ignorable_Code_Point, as ranges
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F),
    (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
JOINER = "‍"


def _character_map() -> dict[int, str]:
    """Per code point of the two lower planes, what it becomes; from the Unicode data at hand."""
    table: dict[int, str] = {}
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000)]:
        sign = chr(code)
        kind = unicodedata.decomposition(sign)
        if unicodedata.category(sign) == "Zs":
            table[code] = " "
        elif kind.startswith(SAME_LOOK) and sign != "ſ":  # the long s has a look of its own
            parts = "".join(table.get(int(x, 16), chr(int(x, 16))) for x in kind.split()[1:])
            # spacing accents decompose to a space and a mark; they are signs of their own
            if not parts.startswith(" "):
                table[code] = unicodedata.normalize("NFC", parts)
    for first, last in IGNORABLE:
        for code in range(first, min(last, 0xE01EF) + 1):
            table[code] = ""
    # invisible controls; tabs and line feeds stay
    for code in [*range(0x0E, 0x20), *range(0x00, 0x09), *range(0x7F, 0x85), *range(0x86, 0xA0)]:
        table[code] = ""
    for sign in "\u0085  \x0b\x0c":
        table[ord(sign)] = "\n"
    table.update({ord(k): v for k, v in LOOK_ALIKES.items()})
    return table


_MAP: dict[int, str] = {}
_LINE_END = re.compile("\r\n?")
_EMOJI_JOIN = re.compile("(?<=[☀-➿\U0001f000-\U0001faff️])‍(?=[☀-➿\U0001f000-\U0001faff])")
_KEPT_JOIN = ""  # stands for a kept joiner while the others are removed


def consistent_form(text: str, fold_case: bool = False) -> str:
    """The form of one text. A text that is empty or has nothing visible becomes what is left of its
    white space; the form of a form is itself. A joiner inside an emoji sequence is part of its look and stays.
    """
    if "\r" in text:
        text = _LINE_END.sub("\n", text)
    if not text.isascii() or not text.isprintable():
        if not _MAP:
            _MAP.update(_character_map())
        if JOINER in text:
            text = text.replace(_KEPT_JOIN, "�")
            text = _EMOJI_JOIN.sub(_KEPT_JOIN, text)
        # canonical decomposition first, so that an accented look-alike is mapped like a bare one
        text = unicodedata.normalize("NFD", text).translate(_MAP)
        text = unicodedata.normalize("NFC", text).replace(_KEPT_JOIN, JOINER)
    return unicodedata.normalize("NFC", text.casefold()) if fold_case else text


def normalise_texts(df: DataFrame, text_col: str, out_col: str = "norm_text", fold_case: bool = False) -> DataFrame:
    """``df`` with ``out_col``, the consistent form of ``text_col``; null stays null, the empty text empty.

    Within each batch every distinct text is brought to its form once. All other columns pass through
    whatever their names; only ``out_col`` must be new. Nothing is shuffled.
    """
    if out_col in df.columns:
        raise ValueError(f"the table has a column {out_col}")
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])
    at = df.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(at).dictionary_encode()
            forms = pa.array([None if x is None else consistent_form(x, fold_case) for x in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, forms.take(coded.indices)], schema=pa.schema([*batch.schema, pa.field(out_col, pa.string())]))

    return df.mapInArrow(work, schema)


def look_keys(df: DataFrame, id_col: str, text_col: str, fold_case: bool = False) -> DataFrame:
    """(id, look_key, text_key) of texts with a visible character: digests of the form and of the text.

    The digests (SHA-256) stand for the texts, so no text is shuffled. Null, empty and blank texts and
    those of invisible characters alone have no row.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    schema = T.StructType([rows.schema["id"], T.StructField("look_key", T.BinaryType()), T.StructField("text_key", T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(1).dictionary_encode()
            look, same = [], []
            for x in coded.dictionary.to_pylist():
                form = consistent_form(x, fold_case)
                look.append(hashlib.sha256(form.encode()).digest() if form.strip() else None)
                same.append(hashlib.sha256(x.encode()).digest())
            look, same = pa.array(look, pa.binary()).take(coded.indices), pa.array(same, pa.binary()).take(coded.indices)
            seen = look.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(seen), look.filter(seen), same.filter(seen)], names=["id", "look_key", "text_key"])

    return rows.mapInArrow(work, schema)


def look_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, class_id, n_members, n_texts): each record whose text has a visible character, the least id of the
    records that look the same, and how many records and different texts these are.

    A null id has no row, repeated ids with one text count once. Counts are made by text before they are
    shuffled, so copies of one text don't meet.
    """
    keys = Workspace(df.sparkSession).keep(look_keys(df, id_col, text_col).where("id is not null")).distinct()
    texts = keys.groupBy("look_key", "text_key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = texts.groupBy("look_key").agg(F.min("least").alias("class_id"), F.sum("n").alias("n_members"), F.count("*").alias("n_texts"))
    return keys.join(classes, "look_key").select("id", "class_id", "n_members", "n_texts")


def same_look_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records whose texts look the same and are not equal as strings.

    Equal texts are grouped first; pairs form between different texts of one form only, never within
    copies of one text. Repeated ids count once.
    """
    # read twice below, so the texts are brought to their form once and the digests are written
    keys = Workspace(df.sparkSession).keep(look_keys(df, id_col, text_col)).distinct()
    forms = keys.groupBy("look_key").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high").select("look_key")
    held = keys.join(forms, "look_key")
    one = held.select("look_key", F.col("id").alias("id_a"), F.col("text_key").alias("key_a"))
    two = held.select("look_key", F.col("id").alias("id_b"), F.col("text_key").alias("key_b"))
    return one.join(two, "look_key").where("key_a <> key_b and id_a < id_b").select("id_a", "id_b").distinct()
