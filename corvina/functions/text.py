"""Scalar text operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the text model.
PARTICLES = ["의", "은", "는", "이", "가", "을", "를", "에", "에서", "에게", "께", "으로", "로", "와", "과", "랑", "이랑", "부터", "까지", "도", "만", "조차", "마저"]
QUERY_PARTICLES = ["에게", "으로", "에서", "하고", "이나", "이다", "까지", "부터", "은", "는", "이", "가", "을", "를", "의", "와", "과", "로"]
TRAILING_CHARS = "은는이가을를의와과로으로에게랑"
STOP_ROOTS = ["누구", "무엇", "언제", "어디", "어떻게", "왜", "관계", "관련", "연결", "사람", "것", "무슨", "어떤"]
TITLES = ["씨", "선생", "배우", "감독", "작가", "님"]
RELATION_WORDS = {
    "master": ["스승", "선생", "master", "teacher", "mentor"],
    "student": ["제자", "학생", "student", "disciple"],
    "전수": ["전수", "전해", "배우", "가르치", "teach", "learn"],
    "관계": ["관계", "연결", "relationship", "connection"],
}
NOISE_PREDICATES = ["관계", "Relation", "Domain", "Range", "특성", "종류", "유형", "타입", "Type", "속성", "Property", "Attribute", "편집"]
PLACEHOLDERS = ["unknown", "none", "null", "n/a"]
PRONOUNS = ["그", "그녀", "이", "그것", "저", "저것", "이것"]


def strip_blanks(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Without line numbers, letters and bullets at line starts; runs of newlines, blanks and tabs collapsed; lines trimmed."""
    for mark in (r"\d+[.)\]]", r"\([a-zA-Z0-9가-힣]\)", r"[a-zA-Z][.)\]]", r"[•\-*▪▸→○●◆◇■□]"):
        c = F.regexp_replace(c, rf"(?md)^\s*{mark}\s+", "")
    for pattern, to in ((r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"\t+", " "), (r"(?md)^[^\S\n]+|[^\S\n]+$", "")):
        c = F.regexp_replace(c, pattern, to)
    return strip_blanks(c)


def clean_entity_name(c: Column) -> Column:
    c = F.regexp_replace(strip_blanks(c), "^[\"']+|[\"']+$", "")
    c = F.regexp_replace(F.regexp_replace(c, r"^\d+[.)\]]\s*", ""), r"^\([a-zA-Z0-9]\)\s*", "")
    return strip_blanks(c)


def normalize_whitespace(c: Column) -> Column:
    """Paragraph breaks stay as two newlines, single newlines become blanks."""
    c = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    mark = " [[PARA]] "
    c = F.replace(F.replace(F.regexp_replace(c, r"\n\s*\n+", mark), F.lit("\n"), F.lit(" ")), F.lit(mark), F.lit("\n\n"))
    return strip_blanks(F.regexp_replace(c, r"[ \t]+", " "))


def _longest_first(words: list[str]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def normalize_entity(c: Column) -> Column:
    """Without the longest particle at the end if two characters or more are left; blanks collapsed."""
    # the shortest stem of two characters or more before a particle leaves the longest particle
    stem = F.regexp_replace(strip_blanks(c), rf"(?s)\A(.{{2,}}?)(?:{_longest_first(PARTICLES)})\z", "$1")
    return strip_blanks(F.regexp_replace(stem, r"\s+", " "))


def canonical_entity(c: Column) -> Column:
    """Quotes and a bracketed letter at the front go, blanks collapse; a number at the front stays."""
    c = F.regexp_replace(strip_blanks(c), "^[\"']+|[\"']+$", "")
    return strip_blanks(F.regexp_replace(F.regexp_replace(c, r"^\([a-zA-Z0-9]\)\s*", ""), r"\s+", " "))


def normalize_predicate(c: Column) -> Column:
    return F.regexp_replace(strip_blanks(c), r"\s+", " ")


def blank_words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def strip_query_particles(query: Column) -> Column:
    """Distinct words without closing marks and one particle, if longer than one character."""
    ending = rf"(?<=.)({'|'.join(QUERY_PARTICLES)})$"

    def bare(w: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(w, "[.,?!]+$", ""), ending, "")

    return F.array_distinct(F.filter(F.transform(blank_words(query), bare), lambda w: F.length(w) > 1))


def relevance_keywords(query: Column, known: Column) -> Column:
    """Words without trailing particle characters that aren't known entities and don't start with a stop root."""
    bare = F.transform(blank_words(F.replace(query, F.lit("?"), F.lit(""))), lambda w: F.regexp_replace(w, f"[{TRAILING_CHARS}]+$", ""))
    stops = F.lit(f"^({'|'.join(STOP_ROOTS)})")
    return F.filter(bare, lambda w: (F.length(w) > 1) & ~F.array_contains(known, w) & ~F.regexp_like(w, stops))


def sanitize_uri(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_replace(strip_blanks(c), "[^a-zA-Z0-9_가-힣Ѐ-ӿ]+", "_"), F.lit("")), F.lit("unknown"))


def to_uri(label: Column, kind: str, base: str = "urn:onto:") -> Column:
    return F.concat(F.lit(base + {"class": "class/", "property": "prop/", "relation": "rel/", "instance": "inst/"}[kind]), F.trim(F.regexp_replace(label, r"[^\p{L}\p{N}]", "_"), F.lit("_")))


def local_name(uri: Column) -> Column:
    return F.substring_index(F.substring_index(uri, "/", -1), "#", -1)


def short_predicate(uri: Column) -> Column:
    """``rel:`` or ``prop:`` and the local name, for predicates of these kinds; else the local name."""
    name = local_name(uri)
    return F.when(uri.contains("/rel/"), F.concat(F.lit("rel:"), name)).when(uri.contains("/prop/"), F.concat(F.lit("prop:"), name)).otherwise(name)


def label_from_uri(uri: Column) -> Column:
    return F.replace(F.url_decode(local_name(uri)), F.lit("_"), F.lit(" "))


def safe_node_label(c: Column) -> Column:
    """Letters, digits, underscores and Hangul; T_ before a digit; null for Entity and for nothing left."""
    bare = F.regexp_replace(c, "[^a-zA-Z0-9_가-힣]", "")
    return F.when((bare == "") | (bare == "Entity"), None).when(bare.rlike("^[0-9]"), F.concat(F.lit("T_"), bare)).otherwise(bare)


def class_from_key(c: Column, is_collection: bool = True) -> Column:
    if is_collection:
        c = F.when(c.endswith("ies") & (F.length(c) > 3), F.concat(F.regexp_replace(c, "ies$", ""), F.lit("y"))).when(
            c.endswith("s") & (F.length(c) > 1), F.regexp_replace(c, "s$", "")
        ).otherwise(c)
    return F.when(c == "", F.lit("Entity")).otherwise(F.concat(F.upper(F.substring(c, 1, 1)), F.substr(c, F.lit(2))))


def chunk_id(doc: Column, version: Column, index: Column) -> Column:
    return F.format_string("%s|%s|%04d", doc.cast("string"), version.cast("string"), index.cast("int"))


def structured_id(doc: Column, identity: Column) -> Column:
    whole = F.concat(doc.cast("string"), F.lit("::struct::"), identity)
    return F.when(F.length(whole) > 120, F.concat(doc.cast("string"), F.lit("::struct::"), F.substring(F.sha1(identity), 1, 16))).otherwise(whole)


def normalize_chunk_ref(c: Column) -> Column:
    return F.replace(c, F.lit("_section_"), F.lit("_"))


def verbalize_entity(label: Column, kind: Column, fields: Column) -> Column:
    """``label (Class): k=v, k=v`` from an array of (key, value)."""
    pairs = F.array_join(F.transform(fields, lambda f: F.concat(f["key"], F.lit("="), f["value"])), ", ")
    return F.concat(label, F.lit(" ("), kind, F.lit("): "), pairs)


def preview_text(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def tokens(c: Column) -> Column:
    """The lower-cased text at blanks."""
    return blank_words(F.lower(c))


def extract_entities(c: Column) -> Column:
    """Two to four Hangul syllables, with a title or without; the title goes, and what is left has two or more."""
    titles = "|".join(TITLES)
    words = F.transform(blank_words(c), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_\s]", ""))
    names = F.filter(words, lambda w: F.regexp_like(w, F.lit(f"^[가-힣]{{2,4}}({titles})?$")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(names, lambda w: F.regexp_replace(w, f"({titles})$", "")), lambda w: F.length(w) >= 2)))


def question_nouns(c: Column, stops: list[str]) -> Column:
    return F.array_except(F.regexp_extract_all(c, F.lit("([가-힣]{2,})")), F.array(*map(F.lit, stops)))


def relation_families(query: Column) -> Column:
    q = F.lower(query)
    return F.array_compact(F.array(*[F.when(F.regexp_like(q, F.lit("|".join(words))), F.lit(name)) for name, words in RELATION_WORDS.items()]))


def query_type(query: Column, hops: Column) -> Column:
    return F.when(hops >= 2, "multi_hop").when(F.size(relation_families(query)) > 0, "relationship").otherwise("simple")


def is_multi_hop(query: Column) -> Column:
    return F.regexp_count(query, F.lit("의")) >= 2


def is_noise_predicate(c: Column) -> Column:
    p = strip_blanks(c)
    return F.coalesce(F.lower(p).isin([x.lower() for x in NOISE_PREDICATES]) | (F.length(p) <= 1), F.lit(True))


def is_valid_entity(c: Column) -> Column:
    e = strip_blanks(c)
    return F.coalesce((F.length(e) >= 2) & ~F.lower(e).isin(PLACEHOLDERS) & ~e.isin(PRONOUNS), F.lit(False))


def sentences(c: Column) -> Column:
    """Sentences end after . ! ? 다 or 요 where blanks follow, and at empty lines."""
    parts = F.split(c, r"(?<=[.!?다요])\s+|\n\n+")
    return F.filter(F.transform(parts, strip_blanks), lambda s: s != "")


def first_number(c: Column) -> Column:
    """The first number in a text, held between 0 and 1; 0 where there is none."""
    return F.least(F.greatest(F.coalesce(F.regexp_extract(c, r"(\d+\.?\d*)", 1).try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


# Tags of nouns, and of nouns, verbs and adjectives.
STRICT_TAGS = ["NNG", "NNP", "NR", "NP", "SL"]
EXTENDED_TAGS = [*STRICT_TAGS, "VV", "VA"]


def tagged_tokens(analysed: Column, extended: bool = False, min_length: int = 1) -> Column:
    """Forms of the tokens (form, tag) of an analyser that have one of the tags and are long enough."""
    tags = EXTENDED_TAGS if extended else STRICT_TAGS
    return F.transform(F.filter(analysed, lambda t: t["tag"].isin(tags) & (F.length(t["form"]) >= min_length)), lambda t: t["form"])


def merge_proper_nouns(analysed: Column) -> Column:
    """Runs of tokens (form, tag) with proper-noun tags as one name each, distinct; names of one character go."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def flush(s: Column) -> Column:
        return F.when(F.length(s["open"]) >= 2, F.array_append(s["done"], s["open"])).otherwise(s["done"])

    def step(s: Column, t: Column) -> Column:
        inside = t["tag"].startswith("NNP")
        return F.struct(F.when(inside, s["done"]).otherwise(flush(s)).alias("done"), F.when(inside, F.concat(s["open"], t["form"])).otherwise("").alias("open"))

    return F.array_distinct(F.aggregate(analysed, start, step, flush))


def result_flags(logs: Column) -> Column:
    """(has_error, used_fallback) by what the lines of a log say; lines that deny a fallback don't count."""
    low = F.transform(logs, F.lower)
    error = F.exists(low, lambda x: x.contains("error") | x.contains("failed"))
    fell = F.exists(low, lambda x: (x.contains("fallback") | x.contains("entity-guided")) & ~x.contains("no fallback") & ~x.contains("fallback search disabled"))
    return F.struct(F.coalesce(error, F.lit(False)).alias("has_error"), F.coalesce(fell, F.lit(False)).alias("used_fallback"))


def ratio_without_library(a: Column, b: Column) -> Column:
    """1 for equal strings whatever the case, 0.8 where one contains the other, else 0."""
    a, b = F.lower(a), F.lower(b)
    return F.when(a == b, 1.0).when(a.contains(b) | b.contains(a), 0.8).otherwise(0.0)
