"""Scalar functions over titles, addresses and publisher names, as Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire import rules

UNICODE = "(?U)"
#: Whole words: Java's word edge looks at Unicode letters only with this flag.
_ASCII_KEYWORD = re.compile(r"[a-z0-9\s_-]+")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


def strings(values: Iterable[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def any_of(tests: Iterable[Column]) -> Column:
    found = F.lit(False)
    for t in tests:
        found = found | t
    return found


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether one of the strings is in the text: one pattern, quoted, so that the plan stays small."""
    return text.rlike("|".join(re.escape(p) for p in parts))


def names_where(tests: dict[str, Column]) -> Column:
    """The names whose test holds, in order."""
    return F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


# Addresses -----------------------------------------------------------------------------------------------------------

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column | str) -> Column:
    """Lower scheme and host, no tracking parameters, no fragment, single slashes, no slash at the end.

    Parameters are kept as they are written; one without a value gets an equals sign. Null gives null, empty gives empty.
    """
    u = F.trim(col(url))
    part = lambda i: F.regexp_extract(u, _URL, i)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    path = F.regexp_replace(part(3), "/{2,}", "/")
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.regexp_replace(path, "/$", "")).otherwise(path)
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*rules.TRACKING_PARAMS))
    query = F.array_join(F.transform(kept, lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))), "&")
    start = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""))
    return F.concat(start, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def url_host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.trim(col(url)), _URL, 2))


def is_intermediary(url: Column | str) -> Column:
    """Addresses of a search engine that only lead elsewhere."""
    return url_host(url).rlike(r"^google\.com$|\.google\.com$|news\.google|google\.co\.uk$")


def search_feed_url(query: Column, language: str) -> Column:
    tail = {"en": "&hl=en-US&gl=US&ceid=US:en", "ko": "&hl=ko&gl=KR&ceid=KR:ko"}[language]
    return F.concat(F.lit("https://news.google.com/rss/search?q="), F.url_encode(query), F.lit(tail))


def article_id(url: Column | str) -> Column:
    return F.concat(F.lit("art_"), F.substring(F.sha2(F.trim(col(url)), 256), 1, 16))


def event_id(url: Column | str) -> Column:
    return F.concat(F.lit("ev_"), F.substring(F.sha2(col(url), 256), 1, 16))


# Titles --------------------------------------------------------------------------------------------------------------


def clean_title(title: Column | str) -> Column:
    """A title for comparison: no brackets, no publisher at the end, lower case, letters, digits and Hangul."""
    # What goes from a title.
    t = F.regexp_replace(col(title), r"^\[.*?\]|【.*?】|\(.*?\)", " ")
    t = F.regexp_replace(t, r"(\s+[-–—]\s+|\s+\|\s+)[^–—|\-]+$", "")
    t = F.regexp_replace(F.lower(t), r"[^a-z0-9가-힣\s]", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def tokens(cleaned: Column, stop: Iterable[str], least: int) -> Column:
    words = F.filter(F.split(cleaned, " "), lambda w: F.length(w) >= least)
    return sorted_set(F.array_except(words, strings(stop)))


def title_tokens(title: Column | str) -> Column:
    return tokens(clean_title(title), rules.STOP_WORDS, 2)


def plain_words(text: Column | str) -> Column:
    # Fixed value: the characters of a word.
    cleaned = F.regexp_replace(F.lower(col(text)), r"[^a-z0-9가-힣\s]", " ")
    return F.trim(F.regexp_replace(cleaned, r"\s+", " "))


def novelty_tokens(title: Column | str) -> Column:
    # Fixed value: the least length of a word.
    return tokens(plain_words(title), rules.NOVELTY_STOP_WORDS, 3)


def title_numbers(title: Column | str) -> Column:
    # Fixed value: what counts as a number.
    return sorted_set(F.regexp_extract_all(F.lower(col(title)), F.lit(r"\b\d+[a-z]?\b"), F.lit(0)))


def similar_titles(norm_a: Column, norm_b: Column, numbers_a: Column, numbers_b: Column, tokens_a: Column, tokens_b: Column) -> Column:
    """Equal once cleaned; or the same numbers and most words in common."""
    common = F.size(F.array_intersect(tokens_a, tokens_b))
    small, large = F.least(F.size(tokens_a), F.size(tokens_b)), F.greatest(F.size(tokens_a), F.size(tokens_b))
    # Words and shares that two titles have in common.
    most = (common >= 4) & ((common / large >= 0.65) | (common / small >= 0.8))
    jaccard = common / F.size(F.array_union(tokens_a, tokens_b))
    near = (common >= 3) & (small >= 4) & (jaccard >= 0.75)
    return ((norm_a == norm_b) & (norm_a != "")) | ((numbers_a == numbers_b) & (small > 0) & (most | near))


# Publishers ----------------------------------------------------------------------------------------------------------


def normal_publisher(name: Column | str) -> Column:
    """One key for the spellings of a publisher: lower case, no domain end, one descriptive word less."""
    # Ends of names.
    n = F.regexp_replace(F.lower(F.trim(col(name))), r"\.com$|\.net$|\.org$|\.io$", "")
    cut = None
    for s in rules.PUBLISHER_SUFFIXES:
        test, value = n.endswith(f" {s}"), F.substring(n, F.lit(1), F.length(n) - F.lit(len(s) + 1))
        cut = F.when(test, value) if cut is None else cut.when(test, value)
    return F.trim(cut.otherwise(n))


def pretty_publisher(name: Column | str) -> Column:
    return F.initcap(F.trim(F.regexp_replace(col(name), r"\s+", " ")))


# Lexicons ------------------------------------------------------------------------------------------------------------


def keyword_pattern(keywords: Iterable[str]) -> str:
    """One pattern for a list: ASCII keywords between word edges, others anywhere."""
    keywords = list(keywords)
    whole = [re.escape(k) for k in keywords if _ASCII_KEYWORD.fullmatch(k)]
    loose = [re.escape(k) for k in keywords if not _ASCII_KEYWORD.fullmatch(k)]
    return "|".join(([rf"\b(?:{'|'.join(whole)})\b"] if whole else []) + loose)


def alias_pattern(aliases: Iterable[str]) -> str:
    """As :func:`keyword_pattern`, but only aliases with Hangul are looked for anywhere."""
    aliases = list(aliases)
    hangul = [a for a in aliases if re.search("[가-힣]", a)]
    whole = [re.escape(a) for a in aliases if a not in hangul]
    return "|".join(([rf"\b(?:{'|'.join(whole)})\b"] if whole else []) + [re.escape(a) for a in hangul])


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(UNICODE + pattern)


def _branches(words: list[str]) -> str:
    """One pattern for all words, that tries longer ones first and each beginning once."""
    after: dict[str, list[str]] = {}
    for w in words:
        if w:
            after.setdefault(w[0], []).append(w[1:])
    parts = [re.escape(c) + _branches(rest) for c, rest in sorted(after.items())]
    if not parts:
        return ""
    one = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return f"(?:{one})?" if "" in words else one


class Lexicon:
    """Names with words that stand for them. All are looked for in one pass over a text: at each place where a word may
    begin the longest that stands there is taken; shorter ones that it begins with are known beforehand.

    ``whole`` words are looked for between edges, others anywhere. ``edges`` are what is before and after a whole word;
    ``parted`` says whether two neighbouring characters within a word are such an edge."""

    def __init__(self, lists: dict[str, Iterable[str]], whole: Callable[[str], bool], edges: tuple[str, str] = (r"\b", r"\b"), parted: Callable[[str, str], bool] | None = None):
        named: dict[str, set[str]] = {}
        for name, words in lists.items():
            for w in words:
                named.setdefault(w, set()).add(name)
        parted = parted or (lambda a, b: bool(re.match(r"\w", a)) != bool(re.match(r"\w", b)))
        self.patterns, self.names = [], {}
        for kind in (True, False):
            own = sorted(w for w in named if w and bool(whole(w)) is kind)
            if not own:
                continue
            before, after = edges if kind else ("", "")
            if before == r"\b" and all(re.match(r"\w", w) for w in own):
                before = r"(?<![a-z0-9_])\b"  # most places are ruled out without the tables of Unicode
            self.patterns.append(f"{UNICODE if kind else ''}{before}(?=({_branches(own)}){after})")
            for w in own:
                begun = [v for v in own if w.startswith(v) and (v == w or not kind or parted(w[len(v) - 1], w[len(v)]))]
                self.names[w] = sorted(set().union(*(named[v] for v in begun)))

    def found(self, text: Column) -> Column:
        """The names whose words are in the text, each once, in no order; null text has none."""
        hits = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in self.patterns)))
        # One literal for the whole table, folded once; its separators are in no word.
        told = F.str_to_map(F.lit("\x1d".join(f"{w}\x1e" + "\x1f".join(names) for w, names in self.names.items())), F.lit("\x1d"), F.lit("\x1e"))
        names = F.flatten(F.transform(F.array_distinct(hits), lambda w: F.split(F.element_at(told, w), "\x1f")))
        return F.array_distinct(F.coalesce(names, strings([])))


def _hangul(word: str) -> bool:
    return bool(re.search("[가-힣]", word))


@cache
def entity_lexicon() -> Lexicon:
    return Lexicon({e[0]: [e[0].lower(), *rules.words(e[4])] for e in rules.ENTITIES}, lambda w: not _hangul(w))


def entities_in(text: Column | str) -> Column:
    """Sorted names of the entities mentioned."""
    return F.array_sort(entity_lexicon().found(F.lower(col(text))))


@cache
def topic_lexicon() -> Lexicon:
    """The topics' patterns are words, between edges or not; a letter before a question mark may be missing, and any letter
    may stand for one."""
    lists, whole = {}, set()
    for name, pattern in rules.TOPICS.items():
        lists[name] = []
        for part in pattern.split("|"):
            words = [part.removeprefix(r"\b").removesuffix(r"\b")]
            while "?" in words[0]:
                words = [v for w in words for v in (w.replace("?", "", 1), w[: w.index("?") - 1] + w[w.index("?") + 1 :])]
            while "[a-z]" in words[0]:
                words = [w.replace("[a-z]", c, 1) for w in words for c in ascii_lowercase]
            edges = part.startswith(r"\b") + part.endswith(r"\b")
            if edges == 1 or any(re.search(r"[\\()\[\].*+]", w) for w in words):
                raise ValueError(f"not a list of words: {pattern}")
            lists[name] += words
            whole.update(words if edges else ())
    return Lexicon(lists, whole.__contains__)


def topics_in(text: Column | str) -> Column:
    """Topics in the order of the rules."""
    found = topic_lexicon().found(F.lower(col(text)))
    return F.array_intersect(strings(rules.TOPICS), found)


def models_in(text: Column | str) -> Column:
    low = F.lower(col(text))
    found = F.flatten(F.array(*(F.regexp_extract_all(low, F.lit(UNICODE + p), F.lit(0)) for p in rules.MODEL_PATTERNS)))
    return sorted_set(F.transform(found, lambda m: F.regexp_replace(m, "[ -]", "")))


def keyed(text: Column, lists: dict[str, str]) -> Column:
    """Sorted names of the keyword lists that the lower-case text matches."""
    return F.array_sort(Lexicon({n: rules.words(k) for n, k in lists.items()}, _ASCII_KEYWORD.fullmatch).found(text))


def effective_actions(actions: Column, themes: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in rules.THEME_ACTIONS.items() for x in kv])
    implied = F.filter(F.transform(themes, lambda t: F.try_element_at(pairs, t)), lambda a: a.isNotNull())
    return sorted_set(F.concat(actions, implied))


def event_anchors(effective: Column, entities: Column, models: Column) -> Column:
    """Every (action, entity, model); an empty side counts as one null, no action as ``general``."""
    acts = F.when(F.size(effective) > 0, effective).otherwise(strings(["general"]))
    one = F.array(F.lit(None).cast("string"))
    ents, mods = F.when(F.size(entities) > 0, entities).otherwise(one), F.when(F.size(models) > 0, models).otherwise(one)
    triple = lambda a, e, m: F.struct(a.alias("action"), e.alias("entity"), m.alias("model"))
    return F.flatten(F.transform(acts, lambda a: F.flatten(F.transform(ents, lambda e: F.transform(mods, lambda m: triple(a, e, m))))))


def concrete_pairs(anchors: Column) -> Column:
    """(entity, model) of the anchors that have both."""
    both = F.filter(anchors, lambda x: x["entity"].isNotNull() & x["model"].isNotNull())
    return F.array_distinct(F.transform(both, lambda x: F.struct(x["entity"].alias("entity"), x["model"].alias("model"))))
