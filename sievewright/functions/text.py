"""Scalar text functions as native column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that Python's str.strip removes; Spark's trim removes the blank only. Fixed values.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(WHITE))


def clean_text(c: Column | str) -> Column:
    """Trimmed text; NULL and any spelling of nan become the empty string."""
    t = F.coalesce(strip(c), F.lit(""))
    return F.when(F.lower(t) == "nan", F.lit("")).otherwise(t)


def key_text(c: Column | str) -> Column:
    """Trimmed lower-case key; NULL where the key is missing (NULL, blank, nan)."""
    return F.nullif(F.lower(clean_text(c)), F.lit(""))


def normalize_url(c: Column | str) -> Column:
    """Catalogue form of a URL: trimmed, https for http, no trailing slashes."""
    return F.regexp_replace(F.regexp_replace(clean_text(c), "^http://", "https://"), "/+$", "")


def normalize_url_parts(c: Column | str) -> Column:
    """Page form of a URL: scheme and host in lower case, runs of slashes in the path collapsed, no fragment, query kept."""
    u = clean_text(c)
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/{2,}", "/")
    query = F.regexp_extract(u, r"^[^?#]*(\?[^#]*)", 1)
    whole = F.concat(scheme, F.lit("://"), host, F.regexp_replace(path, "/+$", ""), query)
    return F.when(scheme == "", u).otherwise(whole)


def split_delimited(c: Column | str, delimiter: str = "|") -> Column:
    """Trimmed, non-empty parts of a delimited text."""
    parts = F.split(clean_text(c), f"\\Q{delimiter}\\E")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def parse_answers(answer: Column, multi_answer: Column) -> Column:
    """Distinct answers in order: the answer, then the parts of multi_answer unless it is a flag; `&&` parts stay together."""
    flag = F.lower(clean_text(multi_answer)).isin("", "0", "1", "true", "false", "yes", "no")
    joined = F.transform(split_delimited(multi_answer), lambda x: F.array_join(F.transform(F.split(x, "&&"), strip), " && "))
    first = F.when(clean_text(answer) == "", F.array().cast("array<string>")).otherwise(F.array(clean_text(answer)))
    return F.array_distinct(F.concat(first, F.when(flag, F.array().cast("array<string>")).otherwise(joined)))


def zip_with_fallback(titles: Column, urls: Column) -> Column:
    """(title, url) pairs by position; a missing title falls back to the first, then to the empty string."""
    return F.transform(urls, lambda u, i: F.struct(F.coalesce(F.get(titles, i), F.get(titles, F.lit(0)), F.lit("")).alias("title"), u.alias("url")))


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys; NULLs are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def stable_id(prefix: str, **fields: Column) -> Column:
    """prefix and the first 24 hexadecimal digits of the digest of the canonical JSON."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(canonical_json(**fields), 256), 1, 24))


def title_of(contents: Column | str) -> Column:
    """The first line of a document, without its quotes."""
    c = F.col(contents) if isinstance(contents, str) else contents
    return F.btrim(strip(F.substring_index(c, "\n", 1)), F.lit('"'))


def body_of(contents: Column | str) -> Column:
    """All lines after the first; the empty string where there is only one."""
    c = F.col(contents) if isinstance(contents, str) else contents
    return F.when(F.instr(c, "\n") > 0, strip(F.substring(c, F.instr(c, "\n") + 1, F.length(c)))).otherwise("")


def normalize_path(c: Column | str) -> Column:
    """Slashes for backslashes, no leading ./ and no runs of slashes."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(clean_text(c), r"\\", "/"), "/{2,}", "/"), r"^(\./)+", "")


def is_safe_member(c: Column | str) -> Column:
    """Whether an archive member's name stays below its root: relative, no parent steps, no NUL, no drive."""
    name = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"\\", "/")
    steps = F.split(name, "/")
    return (name != "") & ~name.startswith("/") & ~F.array_contains(steps, "..") & (F.instr(name, "\0") == 0) & ~name.rlike("^[A-Za-z]:")


def normalize_answer(c: Column | str) -> Column:
    """Lower case, no ASCII punctuation, no articles, single blanks: the form exact match compares."""
    t = F.lower(F.col(c) if isinstance(c, str) else c)
    t = F.regexp_replace(t, r"[!-/:-@\[-`{-~]", "")
    t = F.regexp_replace(t, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def exact_match(prediction: Column, golds: Column) -> Column:
    """1 where the normalised prediction equals any normalised gold answer, else 0."""
    return F.coalesce(F.exists(golds, lambda g: normalize_answer(g) == normalize_answer(prediction)), F.lit(False)).cast("int")


def last_answer(c: Column | str) -> Column:
    """Text of the last <answer> element, NULL where there is none or it is blank."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(c, F.lit("(?s)<answer>(.*?)</answer>"), F.lit(1))
    return F.nullif(strip(F.get(found, F.size(found) - 1)), F.lit(""))


def format_score(correct: Column, well_formed: Column, retrieved: Column) -> Column:
    """Exact-match ladder: 1 right and well-formed, 0.8 right only, 0.2 well-formed with a retrieval hit, 0.1 well-formed, else 0."""
    return F.when(correct & well_formed, 1.0).when(correct, 0.8).when(well_formed & retrieved, 0.2).when(well_formed, 0.1).otherwise(0.0)


def retrieval_penalty(calls: Column, free: int = 2, rate: float = 0.02) -> Column:
    """rate times the square of the calls beyond the free ones."""
    return F.lit(rate) * F.pow(F.greatest(F.lit(0), calls - free), F.lit(2))


def sanitize_tags(c: Column | str, tags: tuple[str, ...] = ("think", "tool_call", "tool_response", "answer", "search", "vision_search", "information", "vision_information")) -> Column:
    """Control tags, with attributes too, and turn marks are escaped, so that quoted text can't act as protocol."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(c, rf"(?i)<(/?(?:{'|'.join(tags)})(?:\s[^>]*)?)>", "&lt;$1&gt;")
    return F.regexp_replace(c, r"(?i)<(\|im_(?:start|end)\|)>", "&lt;$1&gt;")


def sanitize_media(c: Column | str) -> Column:
    """Media placeholders become plain words."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c, r"(?i)<(image|video|audio)>", "[$1]")


def normalize_phrase(c: Column | str) -> Column:
    """Lower case, everything but word characters to single blanks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[^\w]+", " "))


def contains_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase's tokens appear in a row in the text; phrases under two characters never do."""
    p = normalize_phrase(phrase)
    return (F.length(p) >= 2) & F.contains(F.concat(F.lit(" "), normalize_phrase(text), F.lit(" ")), F.concat(F.lit(" "), p, F.lit(" ")))


def gsm8k_strict(c: Column | str) -> Column:
    """The number after the last #### in the last 300 characters, without commas and dollars; NULL if none."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.regexp_extract_all(F.right(c, F.lit(300)), F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
    return F.regexp_replace(F.get(found, F.size(found) - 1), "[,$]", "")


def gsm8k_flexible(c: Column | str) -> Column:
    """The last number in the last 300 characters that isn't bare punctuation; NULL if none."""
    c = F.col(c) if isinstance(c, str) else c
    found = F.filter(F.regexp_extract_all(F.right(c, F.lit(300)), F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.get(found, F.size(found) - 1)


# Fixed values of the final-answer normal form: replacements, then removals, each list in the order it applies.
ANSWER_REPLACEMENTS = (
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
)
ANSWER_REMOVALS = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm",
    "pounds", "meters", "meals", "edges", "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}",
    "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)


def minerva_normalize(c: Column | str) -> Column:
    """The normal form of a final answer: what follows the last equals sign, without units, words and LaTeX dressing."""
    sides = F.split(F.col(c) if isinstance(c, str) else c, "=")
    t = F.get(sides, F.size(sides) - 1)
    for old, new in (*ANSWER_REPLACEMENTS, *((gone, "") for gone in ANSWER_REMOVALS)):
        t = F.replace(t, F.lit(old), F.lit(new))
    # a formula in the answer stands for the whole answer; commands around it are dropped, short arguments get braces
    t = F.regexp_replace(t, r"^[^$]*\$([^$]*)\$.*$", "$1")
    t = F.regexp_replace(t, r"\\(?:text|textbf|overline)\{(.*?)\}", "$1")
    t = F.regexp_replace(t, r"\\boxed\{(.*)\}", "$1")
    t = F.regexp_replace(F.regexp_replace(t, r"frac([^{])(.)", "frac{$1}{$2}"), r"sqrt([^{])", "sqrt{$1}")
    t = F.replace(t, F.lit("$"), F.lit(""))
    whole = F.replace(t, F.lit(","), F.lit(""))
    return F.trim(F.when(whole.rlike("^[0-9]+$"), whole).otherwise(t))


def multiset_similarity(a: Column, b: Column) -> Column:
    """Shared occurrences over all occurrences of two arrays, 1 for two empty ones."""
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def turn_kind(c: Column | str) -> Column:
    """What an assistant's turn is: tool_call, answer, both, or plain."""
    c = F.col(c) if isinstance(c, str) else c
    calls = F.regexp_count(c, F.lit(r"(?s)<tool_call>.*?</tool_call>"))
    answers = F.regexp_count(c, F.lit(r"(?s)<answer>.*?</answer>"))
    return F.when((calls > 0) & (answers > 0), "invalid").when(calls > 1, "invalid").when(answers > 1, "invalid").when(calls == 1, "tool_call").when(answers == 1, "answer").otherwise("plain")


def utf8_prefix(c: Column | str, limit: int) -> Column:
    """The longest prefix of at most `limit` UTF-8 bytes that splits no character."""
    c = F.col(c) if isinstance(c, str) else c
    raw = F.encode(c, "UTF-8")
    # bytes of the form 10xxxxxx continue a character: step back over them to its first byte
    ends = F.array(*[F.lit(limit - back) for back in range(4)])
    starts = F.filter(ends, lambda n: ~F.hex(F.substring(raw, n + 1, F.lit(1))).rlike("^[89AB]"))
    return F.when(F.octet_length(c) <= limit, c).otherwise(F.decode(F.substring(raw, F.lit(1), starts[0]), "UTF-8"))
