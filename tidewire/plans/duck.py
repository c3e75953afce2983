"""DuckDB expressions for the checks: each says in SQL what an operator computes."""

from __future__ import annotations

import re

from tidewire import rules
from tidewire.functions.text import alias_pattern, keyword_pattern
from tidewire.plans.views import ARTICLES


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(values) -> str:
    return "([" + ", ".join(q(v) for v in values) + "]::VARCHAR[])"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {q(pattern)})"


def parts(text: str, values) -> str:
    return has(text, "|".join(re.escape(v) for v in values))


def case(steps, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {t} THEN {v}" for t, v in steps) + f" ELSE {otherwise} END"


def names_where(tests: dict[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {t} THEN {q(n)} END" for n, t in tests.items()) + "], lambda x: x IS NOT NULL)"


def with_articles(body: str, *steps: tuple[str, str]) -> str:
    """Steps are materialised: later ones name a column several times, and its patterns are to be matched once."""
    extra = "".join(f",\n{n} AS MATERIALIZED ({s})" for n, s in steps)
    return f"WITH a AS ({ARTICLES}){extra}\n{body}"


def url(u: str) -> str:
    rx = q(r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?")
    p = lambda i: f"regexp_extract(trim({u}), {rx}, {i})"
    path = f"regexp_replace({p(3)}, '/{{2,}}', '/', 'g')"
    path = f"CASE WHEN length({path}) > 1 AND {path} LIKE '%/' THEN {path}[:-2] ELSE {path} END"
    kept = f"list_filter(string_split({p(4)}, '&'), lambda x: x <> '' AND NOT list_contains({lst(rules.TRACKING_PARAMS)}, lower(string_split(x, '=')[1])))"
    query = f"array_to_string(list_transform({kept}, lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&')"
    return (
        f"(CASE WHEN {p(1)} <> '' THEN lower({p(1)}) || ':' ELSE '' END || CASE WHEN {p(2)} <> '' THEN '//' || lower({p(2)}) ELSE '' END || {path} || "
        f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END)"
    )


def host(u: str) -> str:
    return f"lower(regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.\\-]*:)?(?://([^/?#]*))?', 1))"


def clean_title(t: str) -> str:
    x = f"regexp_replace({t}, {q(r'^\[.*?\]|【.*?】|\(.*?\)')}, ' ', 'g')"
    x = f"regexp_replace({x}, {q(r'(\s+[-–—]\s+|\s+\|\s+)[^–—|\-]+$')}, '')"
    x = f"regexp_replace(lower({x}), {q(r'[^a-z0-9가-힣\s]')}, ' ', 'g')"
    return f"trim(regexp_replace({x}, {q(r'\s+')}, ' ', 'g'))"


def plain(t: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({t}), {q(r'[^a-z0-9가-힣\s]')}, ' ', 'g'), {q(r'\s+')}, ' ', 'g'))"


def tokens(cleaned: str, stop, least: int) -> str:
    return f"list_sort(list_distinct(list_filter(string_split({cleaned}, ' '), lambda x: length(x) >= {least} AND NOT list_contains({lst(stop)}, x))))"


def title_tokens(t: str) -> str:
    return tokens(clean_title(t), rules.STOP_WORDS, 2)


def numbers(t: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({t}), {q(r'\b\d+[a-z]?\b')})))"


def similar(norm, num, tok) -> str:
    """Each argument is a pair of columns."""
    common = f"len(list_intersect({tok[0]}, {tok[1]}))"
    small, large = f"least(len({tok[0]}), len({tok[1]}))", f"greatest(len({tok[0]}), len({tok[1]}))"
    union = f"len(list_distinct(list_concat({tok[0]}, {tok[1]})))"
    return (
        f"(({norm[0]} = {norm[1]} AND {norm[0]} <> '') OR ({num[0]} = {num[1]} AND {small} > 0 AND (({common} >= 4 AND ({common} / {large} >= 0.65 OR {common} / {small} >= 0.8)) "
        f"OR ({common} >= 3 AND {small} >= 4 AND {common} / {union} >= 0.75))))"
    )


def publisher(n: str) -> str:
    x = f"regexp_replace(lower(trim({n})), {q(r'\.com$|\.net$|\.org$|\.io$')}, '')"
    return "trim(" + case([(f"suffix({x}, {q(' ' + s)})", f"{x}[:length({x}) - {len(s) + 1}]") for s in rules.PUBLISHER_SUFFIXES], x) + ")"


def pretty(n: str) -> str:
    words = f"string_split(trim(regexp_replace({n}, {q(r'\s+')}, ' ', 'g')), ' ')"
    return f"array_to_string(list_transform({words}, lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def entities(text: str) -> str:
    return names_where({e[0]: has(f"lower({text})", alias_pattern(dict.fromkeys([e[0].lower(), *rules.words(e[4])]))) for e in sorted(rules.ENTITIES)})


def topics(text: str) -> str:
    return names_where({n: has(f"lower({text})", p) for n, p in rules.TOPICS.items()})


def models(text: str) -> str:
    found = ", ".join(f"regexp_extract_all(lower({text}), {q(p)})" for p in rules.MODEL_PATTERNS)
    return f"list_sort(list_distinct(list_transform(flatten([{found}]), lambda m: regexp_replace(m, '[ -]', '', 'g'))))"


def keyed(text: str, lists: dict[str, str]) -> str:
    return f"list_sort({names_where({n: has(text, keyword_pattern(rules.words(k))) for n, k in lists.items()})})"


def effective(actions: str, themes: str) -> str:
    implied = case([(f"t = {q(k)}", q(v)) for k, v in rules.THEME_ACTIONS.items()], "NULL")
    return f"list_sort(list_distinct(list_filter(list_concat({actions}, list_transform({themes}, lambda t: {implied})), lambda x: x IS NOT NULL)))"


def any_in(values: str, wanted) -> str:
    return f"list_has_any({values}, {lst(wanted)})"


TEXT = "(title || ' ' || excerpt || ' ' || source)"


def classified() -> list[tuple[str, str]]:
    """Steps that end in ``c``: a with entities, topics, primary_category, secondary_categories, tags."""
    low = "lower(text)"
    cats = list(rules.CATEGORIES)
    start = f"CASE WHEN list_contains({lst(cats)}, bucket) THEN bucket ELSE 'frontier_models' END"
    meets, main = parts(low, rules.CONFERENCES), f"(bucket = 'conference' OR {parts(low, rules.CONFERENCE_WORDS)})"
    step = case([(has(low, p), str(k)) for k, (_, p, _) in enumerate(rules.LADDER)], "NULL")
    noted, lifted = [], []
    for k, (name, _, also) in enumerate(rules.LADDER):
        tests = []
        if "source_types" in also:
            tests.append(f"list_contains({lst(also['source_types'])}, source_type)")
        if "words" in also:
            tests.append(parts(low, also["words"]))
        if "entities" in also:
            tests.append(any_in("entities", also["entities"]))
        if "topics" in also:
            tests.append(any_in("topics", also["topics"]))
        noted.append((f"step = {k} AND start <> {q(name)}", q(name)))
        lifted.append((f"step = {k} AND ({' OR '.join(tests)})", q(name)))
    lifted.append((f"step IS NULL AND {any_in('entities', rules.FRONTIER_ENTITIES)}", "'frontier_models'"))
    return [
        ("c1", f"SELECT *, {TEXT} AS text FROM a"),
        ("c2", f"SELECT *, {entities('text')} AS entities, {topics('text')} AS topics, {meets} AS meets, CASE WHEN {meets} AND {main} THEN 'conference' ELSE {start} END AS start, {step} AS step FROM c1"),
        ("c", f"SELECT *, {case(lifted, 'start')} AS primary_category, list_filter([CASE WHEN meets THEN 'conference' END, {case(noted, 'NULL')}], lambda x: x IS NOT NULL) AS secondary_categories, list_concat(entities, list_filter(topics, lambda t: NOT list_contains(entities, t))) AS tags FROM c2"),
    ]


def ladder(text: str, steps, otherwise: str) -> str:
    return case([(parts(text, p), q(n)) for n, p in steps], q(otherwise))


def _known(field: int) -> str:
    from tidewire.functions.sources import _known as known

    return case([(f"k = {q(k)}", q(f[field]) if isinstance(f[field], str) else str(f[field])) for k, f in known().items()], "NULL")


def known(name: str, field: int) -> str:
    return _known(field).replace("k = ", f"lower(trim({name})) = ")


def evidence_level(name: str) -> str:
    return f"coalesce({known(name, 10)}, {ladder(f'lower(trim({name}))', rules.EVIDENCE_LADDER, 'industry_media')})"


def source_type(name: str) -> str:
    return f"coalesce({known(name, 4)}, {ladder(f'lower({name})', rules.TYPE_LADDER, 'media')})"


def authority(name: str, kind: str = "'media'") -> str:
    first = case([(f"contains(lower(trim({name})), {q(k)})", str(v)) for k, v in rules.PUBLISHER_AUTHORITY.items()], "NULL")
    by_type = case([(f"{kind} = {q(k)}", str(v)) for k, v in rules.TYPE_AUTHORITY.items()], str(rules.DEFAULT_AUTHORITY))
    return f"coalesce({first}, {known(name, 5)}, {by_type})"


def normal() -> list[tuple[str, str]]:
    """Steps that end in ``n``: classified stories with level, flags and authority filled in from one another.

    The level comes from the publisher."""
    kind = "source_type"
    level0 = evidence_level("publisher")
    raised = case([("level0 <> 'industry_media'", "level0"), (f"{kind} IN ('official', 'regulator', 'press_release')", "'primary'"), (f"{kind} = 'aggregator'", "'discovery'"), (f"{kind} = 'research'", "'research'"), (f"{kind} = 'community'", "'community'")], "level0")
    return [
        *classified(),
        ("n0", f"SELECT *, {level0} AS level0, coalesce(source_authority, {rules.DEFAULT_AUTHORITY}) AS authority FROM c"),
        ("n", f"SELECT * EXCLUDE (source_authority), authority AS source_authority, {raised} AS evidence_level, {kind} = 'official' AS is_official, {kind} IN ('official', 'regulator', 'press_release') OR level0 = 'primary' AS is_primary_source, level0 = 'independent' AS is_independent_source, {kind} = 'aggregator' OR level0 = 'discovery' AS is_discovery_source FROM n0"),
    ]


def clamp(x: str, low: float, high: float) -> str:
    return half_even(f"least({high}::DOUBLE, greatest({low}::DOUBLE, {x}))", 1)


def half_even(x: str, places: int) -> str:
    """Halves of the number as it is written go to even."""
    f = 10**places
    tens = f"(d * {f} - floor(d * {f}))"
    up = f"CASE WHEN {tens} > 0.5 OR ({tens} = 0.5 AND floor(d * {f}) % 2 = 1) THEN 1 ELSE 0 END"
    return f"list_transform([CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 18))], lambda d: CAST((floor(d * {f}) + {up}) AS DOUBLE) / {f}::DOUBLE)[1]"


def scored() -> list[tuple[str, str]]:
    """Steps that end in ``s``: ``n`` with the six scores and priority_score."""
    from tidewire.plans.views import REF

    base = case([(" OR ".join([*(f"source_type = {q(t)}" for t in types), parts("lower(publisher)", names)]), f"{v}::DOUBLE") for types, names, v in rules.SOURCE_BASES], "75.0::DOUBLE")
    src = clamp(f"CASE WHEN source_authority <> {rules.DEFAULT_AUTHORITY} THEN 0.5::DOUBLE * {base} + 0.5::DOUBLE * source_authority::DOUBLE ELSE {base} END", 10, 100)
    pub, state = "lower(publisher)", ("eu ai office", "nist", "과기정통부")
    pre = parts(f"({pub} || ' ' || {pub} || ' ' || lower(url))", ("arxiv", "biorxiv", "medrxiv", "preprint"))
    evq = case(
        [
            (f"is_discovery_source OR evidence_level = 'discovery' OR source_type = 'aggregator' OR contains({pub}, 'google news') OR contains(lower(url), 'news.google.com')", "40.0::DOUBLE"),
            (f"(is_primary_source OR evidence_level = 'primary') AND (source_type = 'regulator' OR {parts(pub, state)})", "98.0::DOUBLE"),
            ("is_primary_source OR evidence_level = 'primary'", "96.0::DOUBLE"), ("is_independent_source OR evidence_level = 'independent'", "94.0::DOUBLE"),
            (f"(evidence_level = 'research' OR source_type = 'research') AND {pre}", "88.0::DOUBLE"), ("evidence_level = 'research' OR source_type = 'research'", "94.0::DOUBLE"),
            ("evidence_level = 'community' OR source_type = 'community'", "55.0::DOUBLE"), ("evidence_level = 'industry_media' OR source_type = 'media'", "78.0::DOUBLE"),
        ], "70.0::DOUBLE")
    wide = "lower(title || ' ' || excerpt || ' ' || array_to_string(topics, ' ') || ' ' || array_to_string(tags, ' '))"
    terms = " + ".join(f"({has('wide', f'(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)')} OR list_contains(own, {q(t)}))::INT" for t in rules.CORE_TOPICS)
    rel = case([("primary_category IN ('frontier_models', 'agents_coding', 'hardware_infra')", "65.0"), ("primary_category IN ('open_source', 'research_breakthroughs', 'multimodal_media')", "58.0"), ("primary_category IN ('regulation_policy', 'enterprise_app', 'industry_vc')", "45.0")], "30.0")
    imp = case([("primary_category IN ('big', 'frontier_models', 'hardware_infra')", "45.0"), ("primary_category IN ('agents_coding', 'regulation_policy', 'industry_vc')", "38.0")], "28.0")
    signals = " + ".join(f"{has('story', p)}::INT" for p in rules.IMPACT_SIGNALS.values())
    nov = f"90.0 - CASE WHEN {has('lower(title)', rules.EVERGREEN)} THEN 35 WHEN {has('story', rules.EVERGREEN)} THEN 20 ELSE 0 END - CASE WHEN {has('story', rules.PROMOTION)} AND signals = 0 THEN 20 ELSE 0 END"
    hours = f"greatest(0.0::DOUBLE, (epoch(TIMESTAMP '{REF}') - published_s)::DOUBLE) / 3600.0::DOUBLE"
    rec = f"CASE WHEN published_s IS NULL THEN 50.0::DOUBLE ELSE {clamp(f'100.0::DOUBLE * pow(0.5::DOUBLE, {hours} / 36.0::DOUBLE)', 5, 100)} END"
    w = {k: f"{v}::DOUBLE" for k, v in rules.WEIGHTS.items()}
    total = f"{w['relevance']} * relevance_score + {w['impact']} * impact_score + {w['source']} * source_score + {w['evidence']} * evidence_quality_score + {w['recency']} * recency_score + {w['novelty']} * novelty_score"
    boost = "greatest(CASE WHEN impact_score >= 65 AND source_score >= 85 THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN relevance_score >= 80 AND impact_score >= 45 THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END)"
    low = "CASE WHEN relevance_score < 40 AND impact_score < 40 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END"
    return [
        *normal(),
        ("s1", f"SELECT *, {wide} AS wide, lower(title || ' ' || excerpt) AS story, list_transform(list_concat(topics, tags), lambda x: lower(x)) AS own FROM n"),
        ("s2", f"SELECT *, {terms} AS terms, {signals} AS signals FROM s1"),
        ("s3", f"SELECT *, {src} AS source_score, {evq} AS evidence_quality_score, {clamp(f'({rel} + least(terms * 10.0, 40.0))::DOUBLE', 10, 100)} AS relevance_score, {clamp(f'({imp} + least(signals * 16.0, 52.0))::DOUBLE', 10, 100)} AS impact_score, {clamp(f'({nov})::DOUBLE', 10, 100)} AS novelty_score, {rec} AS recency_score FROM s2"),
        ("s", f"SELECT *, {clamp(f'{total} + {boost} - {low}', 10, 100)} AS priority_score FROM s3"),
    ]


def level(score: str = "priority_score") -> str:
    return case([(f"{score} >= {p[1]}", q(p[0])) for p in rules.PRIORITY_LEVELS if p[1]], "'watch'")
