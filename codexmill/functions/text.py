"""General text expressions: Column to Column, evaluated inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: White space of any kind, as Unicode has it.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """White space of any kind off both ends; only the ends are read, not every character by a regular expression."""
    return F.btrim(c, F.lit(WHITE))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def slug(c: Column) -> Column:
    """Lower-case letters and digits joined by hyphens, at most 50."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, 50)


def no_zeros(c: Column) -> Column:
    """Leading zeros off; all zeros leave one."""
    return F.regexp_replace(c, r"^0+(?=.)", "")


def sentences(c: Column) -> Column:
    """Split after ``. ; ! ?`` and white space."""
    return F.split(c, r"(?<=[.;!?])\s+")


def host(url: Column) -> Column:
    """Host without port and ``www.``, lower case; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")


def under(host_: Column, domains: list[str]) -> Column:
    """Whether a host is one of the domains or below one."""
    return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (host_ == d) | F.endswith(host_, F.concat(F.lit("."), d)))


def once(value: Column, f) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Pieces of a block of text, which are cut from the block: a cut reads all of what it is cut from.
BLOCK = 16
#: Characters of a piece's start that are looked for before every length is tried.
START = 16


def chunks(c: Column, size: int = 500, step: int = 450, limit: int | None = None) -> Column:
    """Overlapping pieces, stripped, blank ones left out, at most ``limit`` if given."""
    last = F.ceil(F.length(c) / step).cast("int") - 1
    starts = F.when(F.length(c) > 0, F.sequence(F.lit(0), last, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    block = lambda i: F.substr(c, i * step + 1, F.lit((BLOCK - 1) * step + size))
    cut = lambda i: once(block(i), lambda b: F.transform(F.sequence(F.lit(0), F.least(F.lit(BLOCK - 1), last - i)), lambda j: strip(F.substr(b, j * step + 1, F.lit(size)))))
    pieces = F.filter(F.flatten(F.transform(starts, cut)), lambda x: x != "")
    return pieces if limit is None else F.slice(pieces, 1, limit)


def rejoin(pieces: Column, overlap: int = 200) -> Column:
    """Pieces joined where the longest end of the text so far, up to ``overlap``, equals the next one's start.

    Of the text so far only its last ``overlap`` characters go from piece to piece, and
    what each piece adds is joined once at the end. An end of ``START`` characters or more begins where
    the piece's first ones stand; all lengths are tried only where the first such place is not one.
    """
    none = F.array().cast("array<int>")

    def longest(tail: Column, piece: Column, most: Column) -> Column:
        return F.array_max(F.filter(F.sequence(F.lit(0), most), lambda i: F.endswith(tail, F.substr(piece, F.lit(1), i))))

    def shared(tail: Column, piece: Column) -> Column:
        most = F.least(F.lit(overlap), F.length(piece), F.length(tail))
        found = lambda at: F.startswith(piece, F.substr(tail, at))
        short = longest(tail, piece, F.least(most, F.lit(START - 1)))
        return once(F.position(F.substr(piece, F.lit(1), F.lit(START)), tail), lambda at: F.when(at == 0, short).when(found(at), F.length(tail) - at + 1).otherwise(longest(tail, piece, most)))

    def step(state: Column, piece: Column) -> Column:
        more = lambda k: F.right(F.concat(state["tail"], F.substr(piece, k + 1, F.length(piece))), F.lit(overlap))
        return once(shared(state["tail"], piece), lambda k: F.struct(more(k).alias("tail"), F.array_append(state["cuts"], k).alias("cuts")))

    def joined(all_: Column) -> Column:
        cuts = F.aggregate(all_, F.struct(F.lit("").alias("tail"), none.alias("cuts")), step)["cuts"]
        return F.array_join(F.zip_with(all_, cuts, lambda p, k: F.substr(p, k + 1, F.length(p))), "")

    return once(pieces, joined)


def chunk_id(law: Column, article: Column, index: Column) -> Column:
    """The first 24 hex digits of the SHA-256 of law, article and index."""
    return F.substring(F.sha2(F.concat_ws("|", law, article, index.cast("string")), 256), 1, 24)


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles, navigation, header and footer gone, tags as line breaks, common entities decoded."""
    out = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for tag in ("script", "style", "nav", "footer", "header"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = F.regexp_replace(out, r"<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(out, r"[ \t\r]*\n[ \t\r\n]*", "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def page_title(html: Column) -> Column:
    og = F.nullif(F.regexp_extract(html, r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', 1), F.lit(""))
    return F.coalesce(og, F.nullif(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit("")))


def page_date(html: Column) -> Column:
    """Date of publication as the page's meta tags state it, else null."""
    # The two tags that carry it.
    tags = ('property="article:published_time"', 'name="publishdate"')
    return F.coalesce(*[F.nullif(F.regexp_extract(html, rf'(?is)<meta[^>]*{t}[^>]*content="([^"]*)"', 1), F.lit("")) for t in tags])


def json_objects(c: Column, schema: str, required: str) -> Column:
    """Objects of the JSON array inside free text, those without ``required`` left out; null if there is none or it is malformed."""
    found = F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit("")), f"array<struct<{schema}>>")
    return F.filter(found, lambda o: F.coalesce(o[required], F.lit("")) != "")


def json_field(c: Column, field: str) -> Column:
    """A string field of the JSON object inside free text; of a truncated or malformed one, what stands after the field's opening quote."""
    whole = F.get_json_object(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), f"$.{field}")
    raw = F.nullif(F.regexp_extract(c, rf'(?s)"{field}"\s*:\s*"((?:[^"\\]|\\.)*)', 1), F.lit(""))
    return F.coalesce(whole, F.get_json_object(F.concat(F.lit('{"x":"'), raw, F.lit('"}')), "$.x"))


def valid_uuid(c: Column) -> Column:
    """Whether a text is a UUID: 32 hex digits once hyphens, braces and the urn prefix are off."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "").rlike(r"\A[0-9a-fA-F]{32}\z"), F.lit(False))


def cyclic(values: Column, index: Column) -> Column:
    """Element at an index that starts anew at the end of the list."""
    return F.get(values, F.pmod(index, F.size(values)).cast("int"))


def markdown_sections(docs: DataFrame, text: str = "text", least: int = 60) -> DataFrame:
    """``(doc, pos, title, body)``: sections at second and third level headings whose body has ``least`` characters, titles cut at 80; ``doc`` is the first level heading."""
    heading = r"(?m)^#{2,3}\s+(.+)$"
    s = docs.select(F.regexp_extract(text, r"(?m)^#\s+(.+)$", 1).alias("doc"), F.regexp_extract_all(text, F.lit(heading), 1).alias("heads"), F.posexplode(F.split(text, r"(?m)^#{2,3}\s+.+$")).alias("pos", "body")).where("pos > 0")
    return s.select("doc", "pos", F.substring(strip(F.get("heads", F.col("pos") - 1)), 1, 80).alias("title"), strip(F.col("body")).alias("body")).where(F.length("body") >= least)


def natural(c: Column) -> list[Column]:
    """Order of article numbers by their number, then text; those without a number last."""
    number = F.regexp_extract(c, r"^[0-9]+", 0).try_cast("int")
    return [number.isNull(), number, c]
