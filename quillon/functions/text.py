"""Column expressions on text, ids and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PROPOSED = "proposed:"


def normal_token(text: Column) -> Column:
    """Lower case, without - _ and /, single spaces, trimmed: the form under which vocabulary is looked up."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[-_/]", ""), r"\s+", " "))


def plain_markdown(text: Column) -> Column:
    """Without the marks of bold, italic, underline and code; what they enclose stays."""
    for pattern in (r"\*\*(.+?)\*\*", r"\*(.+?)\*", "__(.+?)__", "`(.+?)`"):
        text = F.regexp_replace(text, pattern, "$1")
    return text


def display_name(name: Column) -> Column:
    """A name for charts: no brackets, cut at a dash or bar, single spaces; ``(unknown)`` if nothing is left."""
    short = F.regexp_replace(name, r"\([^)]*\)", " ")
    short = F.regexp_replace(short, r"\s*(—|–|\s-\s|\|).*$", "")
    short = F.trim(F.regexp_replace(short, r"\s+", " "))
    return F.when(short.isNull() | (short == ""), "(unknown)").otherwise(short)


def matched(canonical: Column) -> Column:
    """Is it a vocabulary name and not a proposal? Null counts as neither."""
    return ~canonical.startswith(PROPOSED)


def month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def days_between(first: Column, last: Column) -> Column:
    return F.datediff(last, first)


def jitter(key: Column, salt: str, width: float = 0.3) -> Column:
    """A stable offset within ±width/2 from the md5 of the key."""
    head = F.conv(F.substring(F.md5(F.concat(key, F.lit(":" + salt))), 1, 8), 16, 10).cast("double")
    return (head / F.lit(float(0xFFFFFFFF)) - 0.5) * width


def author_id(orcid: Column, name: Column) -> Column:
    return F.when(orcid.isNotNull(), F.concat(F.lit("orcid:"), orcid)).otherwise(F.concat(F.lit("name:"), F.replace(F.lower(name), F.lit(" "), F.lit("_"))))


def section_id(project: Column, doc: Column, title: Column, start: Column) -> Column:
    return F.concat_ws(":", project, doc, title, start.cast("string"))


def revision_id(project: Column, doc: Column, label: Column, description: Column) -> Column:
    """The description's digest tells repeated labels apart; an empty one adds nothing."""
    digest = F.when(F.coalesce(description, F.lit("")) != "", F.concat(F.lit("#"), F.substring(F.sha2(description, 256), 1, 8))).otherwise("")
    return F.concat(F.concat_ws(":", project, doc, label), digest)


def edge_id(src: Column, dst: Column, doc: Column, section: Column) -> Column:
    return F.concat(src, F.lit("->"), F.concat_ws(":", dst, doc, section))


def content_hash(content: Column, index: Column | None = None, total: Column | None = None) -> Column:
    """SHA-256 of the text, with the place of a chunk if it is one of several."""
    if index is None:
        return F.sha2(content, 256)
    mark = F.concat(F.lit("|chunk="), index.cast("string"), F.lit("/"), total.cast("string"))
    return F.sha2(F.when(total > 1, F.concat(content, mark)).otherwise(content), 256)


def cache_key(content_digest: Column, prompt: Column, vocab: Column, model: Column) -> Column:
    return F.sha2(F.concat_ws("|", content_digest, prompt, vocab, model), 256)


def claim_type(extra: Column) -> Column:
    return F.get_json_object(extra, "$.claim_type")
