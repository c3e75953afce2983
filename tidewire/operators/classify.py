"""Category, topics and entities of a story, and the template texts that go with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire import rules
from tidewire.functions.text import any_of, contains_any, entities_in, matches, topics_in


def _has_any(values: Column, wanted: tuple[str, ...]) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, wanted)))


def with_taxonomy(df: DataFrame, title: str = "title", excerpt: str = "excerpt", source: str = "source", source_type: str = "source_type", bucket: str = "bucket") -> DataFrame:
    """Add entities, topics, primary_category, secondary_categories and tags.

    A conference is noted on its own; then the first step of the ladder whose pattern is found decides, even where it
    changes nothing; if none is, a frontier lab makes the story one about frontier models.
    """
    text = F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in (title, excerpt, source)))
    out = df.withColumn("_text", text).withColumn("_low", F.lower(F.col("_text")))
    out = out.withColumn("entities", entities_in("_text")).withColumn("topics", topics_in("_text"))
    low, kind = F.col("_low"), F.coalesce(F.col(source_type), F.lit(""))
    start = F.when(F.col(bucket).isin(*rules.CATEGORIES), F.col(bucket)).otherwise(F.lit("frontier_models"))
    meets = contains_any(low, rules.CONFERENCES)
    main = (F.coalesce(F.col(bucket), F.lit("")) == "conference") | contains_any(low, rules.CONFERENCE_WORDS)
    first = None
    for k, (_, pattern, _) in enumerate(rules.LADDER):
        first = F.when(matches(low, pattern), F.lit(k)) if first is None else first.when(matches(low, pattern), F.lit(k))
    out = out.withColumn("_meets", meets).withColumn("_start", F.when(meets & main, F.lit("conference")).otherwise(start)).withColumn("_step", first)
    noted, primary = None, None
    for k, (name, _, also) in enumerate(rules.LADDER):
        tests = []
        if "source_types" in also:
            tests.append(kind.isin(*also["source_types"]))
        if "words" in also:
            tests.append(contains_any(low, also["words"]))
        if "entities" in also:
            tests.append(_has_any(F.col("entities"), also["entities"]))
        if "topics" in also:
            tests.append(_has_any(F.col("topics"), also["topics"]))
        here = F.col("_step") == k
        note, lift = here & (F.col("_start") != name), here & any_of(tests)
        noted = F.when(note, F.lit(name)) if noted is None else noted.when(note, F.lit(name))
        primary = F.when(lift, F.lit(name)) if primary is None else primary.when(lift, F.lit(name))
    primary = primary.when(F.col("_step").isNull() & _has_any(F.col("entities"), rules.FRONTIER_ENTITIES), F.lit("frontier_models")).otherwise(F.col("_start"))
    secondary = F.filter(F.array(F.when(F.col("_meets"), F.lit("conference")), noted), lambda x: x.isNotNull())
    out = out.withColumn("primary_category", primary).withColumn("secondary_categories", F.array_distinct(secondary))
    out = out.withColumn("tags", F.concat("entities", F.array_except("topics", "entities")))
    return out.drop("_text", "_low", "_meets", "_start", "_step")


# What a category means for the field, in Korean and English.
IMPACT = {
    "frontier_models": ("차세대 파운데이션 모델 경쟁과 추론 능력 향상이 산업 전반의 생성형 AI 도입 속도를 가속합니다.", "Next-gen foundation model competition and reasoning advances accelerate enterprise generative AI adoption."),
    "agents_coding": ("자율 AI 에이전트와 소프트웨어 엔지니어링 도구의 발전으로 개발 생산성 및 워크플로 혁신이 본격화됩니다.", "Progress in autonomous agents and SWE tools transforms software development productivity and workflows."),
    "hardware_infra": ("초고속 AI 가속기 및 HBM 메모리 수급, 데이터센터 전력 확보가 AI 인프라 확장의 핵심 병목으로 부상하고 있습니다.", "Next-gen accelerators, HBM memory supply, and datacenter power grids remain critical infrastructure bottlenecks."),
    "open_source": ("고성능 오픈 가중치 모델과 경량화 추론 엔진의 확산으로 온프레미스 및 커스텀 AI 구축 비용이 대폭 절감됩니다.", "High-capability open weights and optimized inference runtimes significantly lower the barrier to custom AI deployment."),
    "research_breakthroughs": ("기초 연구와 새로운 모델 아키텍처는 향후 1~2년 내 상용 AI 제품의 성능 상한을 결정짓는 핵심 지표입니다.", "Fundamental architectural breakthroughs and benchmark achievements set the trajectory for commercial AI systems."),
    "multimodal_media": ("영상, 음성, 3D 등 멀티모달 생성 기술의 고도화가 콘텐츠 제작 및 디지털 인터랙션 패러다임을 전환합니다.", "Advanced multimodal video, audio, and visual generation reshapes content creation and human-computer interfaces."),
    "enterprise_app": ("단순 챗봇을 넘어 실제 엔터프라이즈 업무 자동화와 고부가가치 비즈니스 프로세스 통합이 가속화됩니다.", "Adoption shifts from general chatbots to deep workflow automation and mission-critical enterprise integrations."),
    "regulation_policy": ("EU AI Act 및 각국 안전 프레임워크 시행에 따라 컴플라이언스 준수와 모델 거버넌스가 기업의 핵심 과제로 부각됩니다.", "Enforcement of the EU AI Act and global safety standards makes compliance and model governance a top priority."),
    "industry_vc": ("빅테크 간 파트너십 재편과 스타트업 펀딩 흐름은 차세대 AI 밸류체인의 헤게모니를 결정합니다.", "Strategic tech partnerships and venture funding dynamics redefine the market structure and value chain in AI."),
    "conference": ("글로벌 AI 학회 및 빅테크 개발자 컨퍼런스는 최신 기술 로드맵과 차세대 전략이 공개되는 무대입니다.", "Global academic venues and developer keynotes offer crucial visibility into forthcoming model architectures and roadmaps."),
}
IMPACT_OTHERWISE = ("인공지능 생태계와 글로벌 산업 전반에 걸쳐 유의미한 기술적·사업적 파급효과가 예상됩니다.", "Carries meaningful technological and strategic implications across the global AI ecosystem.")
LABEL_OTHERWISE = ("인공지능 산업", "Artificial Intelligence")


def by_key(key: Column, table: dict[str, tuple], field: int, otherwise: str) -> Column:
    pairs = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v[field]))])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(otherwise))


def with_template_summary(df: DataFrame, category: str = "primary_category") -> DataFrame:
    """Add title_ko/en, summary_ko/en, why_it_matters_ko/en and key_points from the templates."""
    ko, en = (by_key(F.col(category), rules.CATEGORIES, i, LABEL_OTHERWISE[i]) for i in (0, 1))
    hangul, excerpt = F.col("title").rlike("[가-힣]"), F.trim(F.coalesce(F.col("excerpt"), F.lit("")))
    who = F.coalesce(F.nullif(F.col("publisher"), F.lit("")), F.col("source"))
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    given = lambda c, other: F.when(c != "", c).otherwise(other)
    title = F.col("title")
    few = lambda c: F.array_join(F.slice(F.col(c), 1, 4), ", ")
    named = F.when(F.size("entities") > 0, say("주요 기업/모델 (Entities): ", few("entities")))
    about = F.when(F.size("topics") > 0, say("핵심 분야 (Topics): ", few("topics"))).otherwise(say("핵심 분야 (Topics): ", ko, " (", en, ")"))
    # The sentences of the templates.
    return df.withColumns(
        {
            "title_ko": F.when(hangul, title).otherwise(say("[AI 동향] ", title)),
            "title_en": title,
            "summary_ko": F.when(hangul, given(excerpt, say(title, " 관련 ", ko, " 주요 동향입니다."))).otherwise(say(who, "에 따르면, ", title, " 내용이 발표되었습니다. ", ko, " 분야의 주요 전개입니다.")),
            "summary_en": F.when(hangul, say(title, ". Updates in the ", en, " sector reported by ", who, ".")).otherwise(given(excerpt, say(title, ". Strategic updates in the ", en, " ecosystem."))),
            "why_it_matters_ko": by_key(F.col(category), IMPACT, 0, IMPACT_OTHERWISE[0]),
            "why_it_matters_en": by_key(F.col(category), IMPACT, 1, IMPACT_OTHERWISE[1]),
            "key_points": F.filter(F.array(named, about), lambda x: x.isNotNull()),
        }
    )


def with_model_summary(df: DataFrame, summarise, text_col: str = "text") -> DataFrame:
    """Replace summary_en and summary_ko by what ``summarise(title, text)`` returns, (ko, en), on executors; any failure
    or an empty answer leaves the template's. The function may call a model over the network."""

    def run(batches):
        for pdf in batches:
            ko, en = [], []
            for t, x in zip(pdf["title"], pdf[text_col], strict=True):
                try:
                    a, b = summarise(t, x or "")
                except Exception:  # noqa: BLE001  the fallback is the contract
                    a, b = None, None
                ko.append(a or None)
                en.append(b or None)
            pdf["_ko"], pdf["_en"] = ko, en
            yield pdf

    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("_ko", T.StringType()), T.StructField("_en", T.StringType())])
    told = df.mapInPandas(run, schema)
    return told.withColumn("summary_ko", F.coalesce("_ko", "summary_ko")).withColumn("summary_en", F.coalesce("_en", "summary_en")).drop("_ko", "_en")
