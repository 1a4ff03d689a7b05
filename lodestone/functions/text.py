"""Scalar functions on texts and bytes, as column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffix to language. Fixed values.
LANGUAGES = {
    "py": "python", "rs": "rust", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "h": "cpp", "c": "c", "cs": "csharp",
    "go": "go", "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "php": "php", "rb": "ruby",
    "ts": "typescript", "tsx": "tsx",
}
TOKEN_LIMIT = 8192


def is_binary(content: Column) -> Column:
    """Whether bytes hold a zero byte."""
    return F.contains(content, F.lit(bytes([0])))


def encoding(content: Column) -> Column:
    """What bytes are decoded as: UTF-8 where valid, else windows-1252, else ISO-8859-1 where that has no character for a byte."""
    undefined = F.hex(content).rlike("^(?:..)*(?:81|8D|8F|90|9D)")
    return F.when(F.is_valid_utf8(content.cast("string")), "utf-8").when(~undefined, "windows-1252").otherwise("iso-8859-1")


#: The bytes that windows-1252 reads otherwise than ISO-8859-1 does, which is the one of the two that the engine's decode() knows.
_WINDOWS = bytes(b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def decode_text(content: Column) -> Column:
    kind, latin = encoding(content), F.decode(content, "ISO-8859-1")
    windows = F.translate(latin, _WINDOWS.decode("iso-8859-1"), _WINDOWS.decode("windows-1252"))
    return F.when(kind == "utf-8", content.cast("string")).when(kind == "windows-1252", windows).otherwise(latin)


def suffix(path: Column) -> Column:
    """The last suffix of the last path element, without the dot; hidden names without another dot have none."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)$", 1)


def language(path: Column) -> Column:
    pairs = [x for kv in LANGUAGES.items() for x in map(F.lit, kv)]
    return F.coalesce(F.element_at(F.create_map(*pairs), suffix(path)), F.lit("text"))


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(path)


def text_coordinates(text: Column) -> Column:
    """((0, 0), (last row, bytes of the last line)); rows end at line feeds only."""
    lines = F.split(text, "\n", -1)
    end = F.struct((F.size(lines) - 1).alias("row"), F.octet_length(F.element_at(lines, -1)).alias("col"))
    return F.struct(F.struct(F.lit(0).alias("row"), F.lit(0).alias("col")).alias("start"), end.alias("end"))


def line_length(coordinates: Column) -> Column:
    return coordinates["end"]["row"] - coordinates["start"]["row"] + 1


def byte_length(byte_range: Column) -> Column:
    return byte_range["end"] - byte_range["start"]


def token_count(text: Column) -> Column:
    """An offline estimate: a token for every four bytes."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def occurrences(low: Column, phrase: str) -> Column:
    """How often a phrase starts in a lower-case text, overlaps counted.

    Where the phrase can't overlap itself, the length that goes with it tells; a look-ahead pattern counts the others."""
    p = phrase.lower()
    if any(p.startswith(p[i:]) for i in range(1, len(p))):
        quoted = "(?=\\Q" + p.replace("\\E", "\\E\\\\E\\Q") + "\\E)"
        count = F.regexp_count(low, F.lit(quoted))
    else:
        count = ((F.char_length(low) - F.char_length(F.replace(low, F.lit(p), F.lit("")))) / len(p)).cast("int")
    return F.when(F.contains(low, F.lit(p)), count).otherwise(F.lit(0))


def trigram_length(text: Column) -> Column:
    return F.greatest(F.char_length(F.coalesce(text, F.lit(""))) - 2, F.lit(0))


def trigrams(text: Column) -> Column:
    """The distinct case-folded trigrams of a text, in one linear pass (a look-ahead at every place)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("(?s)(?=(...))"), F.lit(1)))


def with_value(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often `use` names it, also inside its own lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def render(path: Column, text: Column, context_before: Column, coordinates: Column, context: bool = True, file: bool = True, line_numbers: bool = False) -> Column:
    """Optional path header, context lines, then the object's lines; one missing last line is tolerated. Lines end at line feeds only.

    The text is split once, and the object's lines are a slice of it, so the cost is linear."""
    first, last = coordinates["start"]["row"], coordinates["end"]["row"]
    width = F.char_length((F.greatest(last, F.coalesce(F.array_max(context_before), F.lit(0))) + 1).cast("string"))

    def numbered(row: Column, line: Column) -> Column:
        return F.concat(F.lpad((row + 1).cast("string"), width, " "), F.lit(" "), line) if line_numbers else line

    def parts(lines: Column) -> Column:
        out = []
        if file:
            out.append(F.array(path, F.lit("")))
        if context:
            out.append(F.transform(context_before, lambda row: numbered(row, F.get(lines, row))))
        body = F.slice(lines, first + 1, F.greatest(last - first + 1, F.lit(0)))
        out.append(F.transform(body, lambda line, i: numbered(first + i, line)) if line_numbers else body)
        return F.array_join(F.concat(*out), "\n")  # lines that aren't there are null and left out

    return with_value(F.split(text, "\n", -1), parts)


def label(path: Column, kind: Column, name: Column) -> Column:
    return F.when(kind == "file", path).otherwise(F.concat(path, F.lit(" ["), kind, F.lit("] "), name))


def json_ids(answer: Column) -> Column:
    """The id list in a model's answer: what stands between its first `[` and last `]`."""
    return F.from_json(F.regexp_extract(answer, r"(?s)(\[.*\])", 1), "array<long>")
