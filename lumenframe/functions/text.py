"""Text expressions: languages, dictionary translation, tokens, tags, labels, identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: character ranges by language, in the order of precedence
SCRIPTS = (("zh", r"[一-鿿]"), ("ja", r"[぀-ゟ゠-ヿ]"), ("ko", r"[가-힯]"), ("th", r"[฀-๿]"))

# fixed values: Vietnamese phrases, replaced in this order
VIETNAMESE = [
    ("người", "people"), ("người đàn ông", "man"), ("người phụ nữ", "woman"), ("trẻ em", "children"), ("ô tô", "car"), ("xe hơi", "car"),
    ("nhà", "house"), ("trong nhà", "indoor"), ("ngoài trời", "outdoor"), ("ban ngày", "day"), ("ban đêm", "night"), ("áo", "shirt"),
    ("quần", "pants"), ("màu đỏ", "red"), ("màu xanh", "blue"), ("đang nói chuyện", "talking"), ("đang đi", "walking"),
    ("đang chơi", "playing"), ("đang làm việc", "working"), ("đang ăn", "eating"), ("đang ngồi", "sitting"),
]

# fixed values: greetings that are answered without a search
GREETINGS = ["hi", "hello", "xin chào", "chào", "chào bạn", "xin chao", "hey"]

# fixed values: search weights of tag, object, description and folder hits
SEMANTIC_WEIGHTS = (0.4, 0.5, 0.3, 0.2)


def detect_language(text: Column, enabled: bool = True) -> Column:
    """Script heuristic: zh, ja, ko, th, else vi for any other non-ASCII sign, else en; blank is en."""
    if not enabled:
        return F.lit("en")
    result = F.when(text.isNull() | (F.trim(text) == ""), "en")
    for code, signs in SCRIPTS:
        result = result.when(text.rlike(signs), code)
    return result.when(text.rlike(r"[^\x00-\x7F]"), "vi").otherwise("en")


def translate_dictionary(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """Replaces phrases one after the other, in the order given."""
    out = text
    for source, target in phrases:
        out = F.replace(out, F.lit(source), F.lit(target))
    return out


def structured_query(text: Column, phrases: list[tuple[str, str]]) -> Column:
    """Offline query understanding: prompt, confidence and language.

    Blank text has confidence 0; English passes at 0.1; translated text has 0.3.
    """
    language = detect_language(text)
    blank = text.isNull() | (F.trim(text) == "")
    prompt = F.when(blank, F.coalesce(text, F.lit(""))).when(language == "vi", translate_dictionary(text, phrases)).otherwise(text)
    confidence = F.when(blank, 0.0).when(language == "vi", 0.3).otherwise(0.1)
    return F.struct(prompt.alias("clip_prompt"), confidence.alias("confidence"), language.alias("language"))


#: Parts of an understood query that only a language model fills in.
QUERY_PARTS = ("objects", "actions", "scene", "time", "style", "mood")


def full_query(text: Column, phrases: list[tuple[str, str]], vocabulary: dict[str, list[str]] | None = None) -> Column:
    """All fields of a structured query, offline: prompt, confidence, language, and its parts.

    A part holds the words of the prompt that the vocabulary lists for it, in
    order and joined by commas; without any it is null.
    """
    known = structured_query(text, phrases)
    words = terms(known["clip_prompt"])

    def part(name: str) -> Column:
        listed = (vocabulary or {}).get(name, [])
        found = F.array_join(F.filter(words, lambda w: w.isin(*listed)), ", ") if listed else F.lit("")
        return F.when(found != "", found).alias(name)

    parts = [part(name) for name in QUERY_PARTS]
    return F.struct(*parts, known["clip_prompt"].alias("clip_prompt"), known["confidence"].alias("confidence"), known["language"].alias("language"))


def query_key(text: Column) -> Column:
    """Cache key of an understood query: its language and the digest of the text as it stands."""
    return F.concat_ws("_", detect_language(text), F.md5(F.coalesce(text, F.lit(""))))


def effective_prompt(text: Column, query: Column, strict: bool = False, least: float = 0.3) -> Column:
    """The rewritten prompt if its confidence reaches ``least`` (``strict``: exceeds it), else the text."""
    ok = query["confidence"] > least if strict else query["confidence"] >= least
    return F.when(ok, query["clip_prompt"]).otherwise(text)


def clean(text: Column, limit: int = 1000) -> Column:
    """Trimmed and cut; null if nothing is left."""
    cut = F.substring(F.trim(text), 1, limit)
    return F.when(F.length(cut) > 0, cut)


def terms(text: Column) -> Column:
    """Distinct lower-cased terms between blanks, in order."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != ""))


def semantic_parts(tags: Column, objects: Column, description: Column, folder: Column) -> Column:
    """The distinct lower-cased terms of a row that a query is scored against."""
    low = lambda a: F.array_distinct(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.lower(x)))
    folders = F.array_distinct(F.split(F.lower(F.coalesce(folder, F.lit(""))), "_"))
    return F.struct(low(tags).alias("tags"), low(objects).alias("objects"), terms(description).alias("description"), folders.alias("folder"))


def parts_score(query_terms: Column, parts: Column, weights=SEMANTIC_WEIGHTS) -> Column:
    """Weighted counts of shared terms; unbounded above."""
    total = F.lit(0.0)
    for weight, name in zip(weights, ("tags", "objects", "description", "folder"), strict=True):
        total = total + F.lit(weight) * F.size(F.array_intersect(query_terms, parts[name]))
    return total


def semantic_score(query_terms: Column, tags: Column, objects: Column, description: Column, folder: Column, weights=SEMANTIC_WEIGHTS) -> Column:
    return parts_score(query_terms, semantic_parts(tags, objects, description, folder), weights)


def token_features(text: Column) -> Column:
    """Counts: blank-separated tokens, numbers, single letters, punctuation."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    count = lambda rule: F.regexp_count(text, F.lit(rule)).cast("long")
    return F.struct(
        F.size(tokens).cast("long").alias("n_tokens"),
        count("[0-9]+").alias("n_numbers"),
        F.size(F.filter(tokens, lambda x: x.rlike("^[A-Za-z]$"))).cast("long").alias("n_letters"),
        count("[!-/:-@\\[-`{-~]").alias("n_punctuation"),
    )


def token_lists(text: Column) -> Column:
    """The lists behind ``token_features``: tokens, numbers, single letters, signs."""
    text = F.coalesce(text, F.lit(""))
    tokens = F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    every = lambda rule: F.regexp_extract_all(text, F.lit(rule), F.lit(0))
    return F.struct(
        tokens.alias("tokens"), F.transform(tokens, F.lower).alias("lemmas"), every("[0-9]+").alias("numbers"),
        F.filter(tokens, lambda x: x.rlike("^[A-Za-z]$")).alias("letters"), every("[!-/:-@\\[-`{-~]").alias("punctuation"),
    )


def label_block(text: Column, name: Column, others: Column, default: Column) -> Column:
    """Text after ``[name]:``, ``Frame name:`` or ``name:`` up to the next label of one of ``others``.

    Case-insensitive; the first form that occurs anywhere wins, at its first place.
    """
    low = F.lower(text)

    def forms(key: Column) -> list[Column]:
        key = F.lower(key)
        return [F.concat(F.lit("["), key, F.lit("]:")), F.concat(F.lit("frame "), key, F.lit(":")), F.concat(key, F.lit(":"))]

    start = F.lit(0)
    for form in reversed(forms(name)):
        at = F.call_function("locate", form, low)
        start = F.when(at > 0, at + F.length(form)).otherwise(start)
    labels = F.flatten(F.transform(F.array_except(others, F.array(name)), lambda o: F.array(*forms(o))))
    ends = F.filter(F.transform(labels, lambda f: F.call_function("locate", f, low, start)), lambda p: p > 0)
    end = F.coalesce(F.array_min(ends), F.length(text) + 1)
    body = F.trim(F.substring(text, start, end - start))
    return F.when((start > 0) & (F.length(body) > 0), body).otherwise(default)


def is_greeting(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text)).isin(GREETINGS), F.lit(False))


def frame_id(name: Column, mapped: Column | None = None) -> Column:
    """Mapped id (unless -1), else the name as a number, else its last run of digits, else -1."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1))
    last = F.when(F.size(runs) > 0, F.element_at(runs, -1))
    plain = F.when(name.rlike("^[0-9]+$"), name)
    found = F.coalesce(plain.try_cast("long"), last.try_cast("long"), F.lit(-1).cast("long"))
    return found if mapped is None else F.coalesce(F.when(mapped != -1, mapped.cast("long")), found)


def fallback_frame_id(stem: Column) -> Column:
    """The stem as a number, else a hash below 999999 that is the same on every machine."""
    return F.coalesce(F.when(stem.rlike("^[0-9]+$"), stem).try_cast("long"), F.pmod(F.xxhash64(stem), F.lit(999_999).cast("long")))


def relative_path(path: Column, root: str = "keyframes") -> Column:
    """From the component ``root`` on; else ``root/<parent>/<file>``; else the file name."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: x != "")
    at, n = F.array_position(parts, F.lit(root)), F.size(parts)
    tail = F.array_join(F.slice(parts, F.greatest(at, F.lit(1)).cast("int"), F.greatest(n, F.lit(1))), "/")
    pair = F.concat_ws("/", F.lit(root), F.get(parts, n - 2), F.get(parts, n - 1))
    return F.when(at > 0, tail).when(n >= 2, pair).otherwise(F.coalesce(F.get(parts, n - 1), F.lit("")))


def update_tags(tags: Column, new: Column) -> Column:
    """Tags with the new ones that aren't blank, each once, in order."""
    added = F.filter(F.coalesce(new, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return F.array_distinct(F.concat(F.coalesce(tags, F.array().cast("array<string>")), added))


def short_id(value: Column) -> Column:
    return F.substring(F.md5(value), 1, 12)


def content_id(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 16)


def frame_reference(text: Column) -> Column:
    """``folder:frame`` split once; the frame is null if absent."""
    parts = F.split(F.trim(text), ":", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("folder"), F.trim(F.get(parts, F.lit(1))).alias("frame"))


#: Words for "no frames".
NO_FRAMES = ("", "[]", "null", "none")


def frame_list(text: Column) -> Column:
    """Identifiers of a list in any of its forms: JSON (quotes of either kind), comma-separated, or one alone.

    Null, blank, ``[]`` and words for nothing are the empty list.
    """
    trimmed = F.trim(F.coalesce(text, F.lit("")))
    json = F.from_json(F.replace(trimmed, F.lit("'"), F.lit('"')), "array<string>")
    looks = trimmed.rlike(r"^\[.*\]$") & json.isNotNull()
    plain = F.filter(F.transform(F.split(trimmed, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.lower(trimmed).isin(*NO_FRAMES), F.array().cast("array<string>")).when(looks, json).otherwise(plain)


def frame_references(text: Column, most: int = 5) -> Column:
    """The first ``most`` of a list as ``folder, frame, problem``; one without a colon says what is wrong."""
    listed = F.filter(frame_list(text), lambda x: F.trim(x) != "")

    def one(x: Column) -> Column:
        ref, ok = frame_reference(x), F.contains(x, F.lit(":"))
        problem = F.when(~ok, F.concat(F.lit("not a folder:frame reference: "), x))
        return F.struct(F.when(ok, ref["folder"]).alias("folder"), F.when(ok, ref["frame"]).alias("frame"), problem.alias("problem"))

    return F.transform(F.slice(listed, 1, most), one)


def frame_key(folder: Column, image: Column) -> Column:
    """``folder_image``, for display; joins use the two columns."""
    return F.concat(folder, F.lit("_"), image)


def parse_frame_key(key: Column) -> Column:
    """``folder`` and ``image``, parted at the first underscore; without one there is no image."""
    parts = F.split(key, "_", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("folder"), F.get(parts, F.lit(1)).alias("image"))


def display_id(folder: Column, frame: Column) -> Column:
    return F.concat_ws("-", folder.cast("string"), frame.cast("string"))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    """``1 frame``, ``2 frames``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or f"{one}s"))


def safe_text(text: Column, limit: int = 100) -> Column:
    """One line for a log: control signs become blanks; cut to ``limit`` with an ellipsis."""
    line = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x1F\x7F]+", " ")
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("..."))).otherwise(line)


def log_message(message: Column, **values: Column) -> Column:
    """``message | a=1 b=2``; without values the message alone."""
    pairs = [F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("null"))) for k, v in values.items()]
    return F.concat_ws(" | ", message, F.concat_ws(" ", *pairs)) if pairs else message
