"""Naming communities without a remote model.

Input: ``membership(node, community)`` with node ids ``path:identifier``
(code graphs) or any string, and optionally ``elements(node, name, kind)``.
Word statistics are grouped counts per (community, word); "first seen"
tie-breaks use the smallest (node, position) — node lists are sorted,
where the reference used insertion order.  Top-k per community uses
``row_number() <= k`` (planned as a window group limit over distinct
words, never over the community's members).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpusgraph.functions.scalars import title_case

# ---- fixed values: keyword → display word, per language ------------------
FUNCTION_WORDS = {
    "en": {
        "agent": "Agent", "compression": "Compression", "performance": "Performance",
        "monitor": "Monitor", "memory": "Memory", "message": "Message", "workflow": "Workflow",
        "static": "Static", "dynamic": "Dynamic", "enhanced": "Enhanced", "multi": "Multi",
        "demo": "Demo", "test": "Test", "config": "Config", "api": "API", "service": "Service",
        "handler": "Handler", "manager": "Manager", "processor": "Processor",
        "analyzer": "Analyzer", "detector": "Detector", "generator": "Generator",
        "validator": "Validator", "optimizer": "Optimizer", "controller": "Controller",
        "executor": "Executor", "scheduler": "Scheduler", "router": "Router", "filter": "Filter",
        "parser": "Parser", "formatter": "Formatter", "transformer": "Transformer",
        "adapter": "Adapter", "factory": "Factory", "builder": "Builder", "helper": "Helper",
        "util": "Utility", "common": "Common", "base": "Base", "core": "Core", "main": "Main",
        "client": "Client", "server": "Server", "model": "Model", "view": "View",
        "component": "Component", "module": "Module", "system": "System",
        "framework": "Framework", "library": "Library", "package": "Package",
        "interface": "Interface", "abstract": "Abstract", "concrete": "Concrete",
        "implementation": "Implementation",
    },
    "zh": {
        "agent": "智能体", "compression": "压缩", "performance": "性能监控", "monitor": "监控",
        "memory": "内存管理", "message": "消息处理", "workflow": "工作流", "static": "静态",
        "dynamic": "动态", "enhanced": "增强", "multi": "多", "demo": "演示", "test": "测试",
        "config": "配置", "api": "API接口", "service": "服务", "handler": "处理器",
        "manager": "管理器", "processor": "处理器", "analyzer": "分析器", "detector": "检测器",
        "generator": "生成器", "validator": "验证器", "optimizer": "优化器",
        "controller": "控制器", "executor": "执行器", "scheduler": "调度器", "router": "路由器",
        "filter": "过滤器", "parser": "解析器", "formatter": "格式化器", "transformer": "转换器",
        "adapter": "适配器", "factory": "工厂", "builder": "构建器", "helper": "辅助",
        "util": "工具", "common": "通用", "base": "基础", "core": "核心", "main": "主要",
        "client": "客户端", "server": "服务端", "model": "模型", "view": "视图",
        "component": "组件", "module": "模块", "system": "系统", "framework": "框架",
        "library": "库", "package": "包", "interface": "接口", "abstract": "抽象",
        "concrete": "具体", "implementation": "实现",
    },
}
MODULE_SUFFIX = {"en": " Module", "zh": "模块"}
JOINER = {"en": " ", "zh": ""}
GENERIC_NAMES = {"en": ("Large Functional Module", "Medium Functional Module", "Small Functional Module"),
                 "zh": ("大型功能模块", "中型功能模块", "小型功能模块")}
KIND_GROUP_ZH = {"class": "类群组", "function": "函数群组", "module": "模块群组"}
COMMON_WORD_SHARE = 0.3   # a file-name word is common above 30 % of the files
MIN_PREFIX = 3            # a common prefix counts when longer than 3 characters
# ---------------------------------------------------------------------------


def split_identifier(ident) -> Column:
    """camel/number runs, plus the ``_`` parts when ``_`` is present;
    lower-cased, trimmed, alphabetic and longer than two characters."""
    c = F.col(ident) if isinstance(ident, str) else ident
    runs = F.regexp_extract_all(c, F.lit(r"([A-Z][a-z]*|[a-z]+|[0-9]+)"), 1)
    parts = F.when(c.contains("_"), F.split(c, "_", -1)).otherwise(F.array().cast("array<string>"))
    words = F.transform(F.concat(runs, parts), lambda w: F.trim(F.lower(w)))
    return F.filter(words, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$"))


def _mapped(word: Column, lang: str) -> Column:
    m = F.create_map(*[x for k, v in FUNCTION_WORDS[lang].items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.lower(word)), title_case(word))


def build_name(words: Column, lang: str = "en") -> Column:
    """F8: at most two words, dictionary-mapped else title-cased, + suffix."""
    mapped = F.transform(F.slice(words, 1, 2), lambda w: _mapped(w, lang))
    return F.concat(F.array_join(mapped, JOINER[lang]), F.lit(MODULE_SUFFIX[lang]))


def _top_words(words: DataFrame, k: int, min_count_col: Column | None = None) -> DataFrame:
    """``words(community, node, pos, word)`` → ``community, top`` (array,
    by count desc then first occurrence), only words passing the filter."""
    wc = (words.groupBy("community", "word")
          .agg(F.count("*").alias("cnt"), F.min(F.struct("node", "pos")).alias("first")))
    if min_count_col is not None:
        wc = wc.join(min_count_col, "community").where(F.col("cnt") > F.col("threshold"))
    w = Window.partitionBy("community").orderBy(F.desc("cnt"), F.asc("first"))
    return (wc.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .groupBy("community")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "word"))),
                             lambda s: s["word"]).alias("top")))


def _exploded(df: DataFrame, text: Column) -> DataFrame:
    return df.select("community", "node", F.posexplode(split_identifier(text)).alias("pos", "word"))


def name_from_nodes(membership: DataFrame, lang: str = "en") -> DataFrame:
    """words of the identifiers after the last ``:``; top two with
    count > 1."""
    ided = membership.where(F.col("node").contains(":")).withColumn(
        "ident", F.element_at(F.split("node", ":"), -1))
    top = _top_words(_exploded(ided, F.col("ident")), 2,
                     membership.select("community").distinct().withColumn("threshold", F.lit(1)))
    return top.where(F.size("top") > 0).select("community", build_name(F.col("top"), lang).alias("name"))


def name_from_elements(membership: DataFrame, elements: DataFrame, lang: str = "en") -> DataFrame:
    """words of element names with count > 1 among the top three, else
    the dominant element kind (``<Kind> Group``)."""
    el = membership.join(elements.select("node", "name", "kind"), "node")
    top = _top_words(_exploded(el, F.col("name")), 3,
                     membership.select("community").distinct().withColumn("threshold", F.lit(1)))
    kind_rank = (el.groupBy("community", "kind").agg(F.count("*").alias("n"), F.min("node").alias("first")))
    w = Window.partitionBy("community").orderBy(F.desc("n"), F.asc("first"))
    dominant = kind_rank.withColumn("_rn", F.row_number().over(w)).where("_rn = 1") \
        .select("community", "kind")
    kind_name = (F.concat(title_case(F.col("kind")), F.lit(" Group")) if lang == "en" else
                 F.coalesce(F.element_at(F.create_map(*[x for k, v in KIND_GROUP_ZH.items()
                                                        for x in (F.lit(k), F.lit(v))]), F.col("kind")),
                            F.concat(F.col("kind"), F.lit("群组"))))
    return (dominant.join(top, "community", "left")
            .select("community", F.when(F.size(F.coalesce("top", F.array())) > 0,
                                        build_name(F.col("top"), lang))
                    .when(F.col("kind") != "unknown", kind_name).alias("name"))
            .where(F.col("name").isNotNull()))


def name_from_paths(membership: DataFrame, lang: str = "en") -> DataFrame:
    """F9 with F7: file stems of ``path:ident`` nodes; common prefix (> 3
    characters, trailing ``_-`` cut) and words present in more than 30 % of
    the stems form the patterns; otherwise the most frequent stem."""
    st = (membership.where(F.col("node").contains(":"))
          .withColumn("path", F.split("node", ":")[0])
          .withColumn("stem", F.regexp_replace(F.element_at(F.split("path", "/"), -1),
                                               r"\.[^.]*$", "")))
    lo_hi = st.groupBy("community").agg(F.min("stem").alias("lo"), F.max("stem").alias("hi"),
                                        F.count("*").alias("n_files"))
    # longest common prefix of min and max = common prefix of the whole list
    lcp_len = F.aggregate(F.sequence(F.lit(1), F.least(F.length("lo"), F.length("hi"))),
                          F.struct(F.lit(0).alias("n"), F.lit(True).alias("run")),
                          lambda acc, i: F.struct(
                              F.when(acc["run"] & (F.substring("lo", i, 1) == F.substring("hi", i, 1)),
                                     i).otherwise(acc["n"]).alias("n"),
                              (acc["run"] & (F.substring("lo", i, 1) == F.substring("hi", i, 1)))
                              .alias("run")))["n"]
    prefix = lo_hi.select("community", "n_files",
                          F.when((F.length("lo") > 0) & (F.length("hi") > 0),
                                 F.left("lo", lcp_len)).otherwise(F.lit("")).alias("prefix"))
    thresholds = prefix.select("community", (F.col("n_files") * COMMON_WORD_SHARE).alias("threshold"))
    common = _top_words(_exploded(st, F.col("stem")), 3, thresholds)
    stem_rank = st.groupBy("community", "stem").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    w = Window.partitionBy("community").orderBy(F.desc("n"), F.asc("first"))
    top_stem = stem_rank.withColumn("_rn", F.row_number().over(w)).where("_rn = 1") \
        .select("community", "stem")
    pats = F.concat(F.when(F.length("prefix") > MIN_PREFIX,
                           F.array(F.regexp_replace("prefix", r"[_-]+$", ""))).otherwise(F.array()),
                    F.coalesce("common.top", F.array().cast("array<string>")))
    j = prefix.join(common.alias("common"), "community", "left").join(top_stem, "community")
    return j.select("community", F.when(F.size(pats) > 0, build_name(pats, lang))
                    .otherwise(build_name(split_identifier(F.col("stem")), lang)).alias("name"))


def generic_name(size, lang: str = "en") -> Column:
    """F14."""
    big, mid, small = GENERIC_NAMES[lang]
    s = F.col(size) if isinstance(size, str) else size
    return F.when(s >= 20, big).when(s >= 10, mid).otherwise(small)


def community_names(membership: DataFrame, elements: DataFrame | None = None,
                    lang: str = "en", descriptions: DataFrame | None = None) -> DataFrame:
    """description (F12, when given: ``community, functionality,
    functional_tags, architecture_pattern``) → paths → elements → node
    identifiers → generic by size."""
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    if descriptions is not None:
        sizes = sizes.join(descriptions.select(
            "community", name_from_description("functionality", "functional_tags",
                                               "architecture_pattern", lang).alias("n_desc")),
            "community", "left")
    else:
        sizes = sizes.withColumn("n_desc", F.lit(None).cast("string"))
    out = sizes.join(name_from_paths(membership, lang).withColumnRenamed("name", "n_paths"),
                     "community", "left")
    if elements is not None:
        out = out.join(name_from_elements(membership, elements, lang)
                       .withColumnRenamed("name", "n_elements"), "community", "left")
    else:
        out = out.withColumn("n_elements", F.lit(None).cast("string"))
    out = out.join(name_from_nodes(membership, lang).withColumnRenamed("name", "n_nodes"),
                   "community", "left")
    return out.select("community", "size",
                      F.coalesce("n_desc", "n_paths", "n_elements", "n_nodes", generic_name("size", lang))
                      .alias("name"))


def context_sample(membership: DataFrame, elements: DataFrame) -> DataFrame:
    """per community up to 5 file stems, 5 function and 3 class names
    (distinct, sorted; bounded top-k, not whole lists)."""
    el = membership.join(elements.select("node", "name", "kind", "file_path"), "node") \
        .withColumn("stem", F.regexp_replace(F.element_at(F.split("file_path", "/"), -1),
                                             r"\.[^.]*$", ""))

    def top(df, col, k, alias):
        d = df.select("community", F.col(col).alias("v")).distinct()
        w = Window.partitionBy("community").orderBy("v")
        return (d.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
                .groupBy("community").agg(F.array_sort(F.collect_list("v")).alias(alias)))
    comms = membership.select("community").distinct()
    return (comms.join(top(el, "stem", 5, "files"), "community", "left")
            .join(top(el.where(F.col("kind") == "function"), "name", 5, "functions"), "community", "left")
            .join(top(el.where(F.col("kind") == "class"), "name", 3, "classes"), "community", "left"))


def enrich(descriptions: DataFrame, names: DataFrame, profiles: DataFrame) -> DataFrame:
    """description ⋈ name ⋈ profile; a missing name is
    ``Community <id>``."""
    return (profiles.join(descriptions, "community", "left").join(names.select("community", "name"),
                                                                  "community", "left")
            .withColumn("name", F.coalesce(F.col("name"),
                                           F.concat(F.lit("Community "), F.col("community").cast("string")))))


# ---- fixed values: secondary fallback keywords (checked in this order) ---
FALLBACK_KEYWORDS = [
    ("agent", "智能体"), ("message", "消息处理"), ("memory", "内存管理"), ("performance", "性能监控"),
    ("config", "配置管理"), ("util", "工具函数"), ("helper", "辅助功能"), ("handler", "处理器"),
    ("manager", "管理器"), ("processor", "处理器"), ("analyzer", "分析器"), ("generator", "生成器"),
]
FALLBACK_SIZE_NAMES = ("大型功能", "中型功能", "小型功能")   # size >= 10, >= 5, else
# ---------------------------------------------------------------------------


def fallback_names(membership: DataFrame, elements: DataFrame) -> DataFrame:
    """F16: most frequent file stem of the community's elements (first seen
    wins ties), mapped by the first keyword it contains, else ``Stem功能``;
    without elements a size class."""
    el = membership.join(elements.select("node", "file_path"), "node") \
        .withColumn("stem", F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", ""))
    ranked = el.groupBy("community", "stem").agg(F.count("*").alias("n"), F.min("node").alias("first"))
    w = Window.partitionBy("community").orderBy(F.desc("n"), F.asc("first"))
    top = ranked.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select("community", "stem")
    low = F.lower(F.col("stem"))
    mapped = None
    for k, v in FALLBACK_KEYWORDS:
        mapped = F.when(low.contains(k), F.lit(v)) if mapped is None else mapped.when(low.contains(k), F.lit(v))
    by_stem = mapped.otherwise(F.concat(title_case(F.col("stem")), F.lit("功能")))
    sizes = membership.groupBy("community").agg(F.count("*").alias("size"))
    big, mid, small = FALLBACK_SIZE_NAMES
    by_size = F.when(F.col("size") >= 10, big).when(F.col("size") >= 5, mid).otherwise(small)
    return (sizes.join(top, "community", "left")
            .select("community", F.when(F.col("stem").isNotNull(), by_stem).otherwise(by_size).alias("name")))


# ---- fixed values: description keywords (checked in this order) ----------
DESCRIPTION_TERMS = [
    ("验证", "validation"), ("校验", "validation"), ("检查", "validation"), ("压缩", "compression"),
    ("解压", "compression"), ("监控", "monitoring"), ("监测", "monitoring"), ("分析", "analysis"),
    ("解析", "parsing"), ("处理", "processing"), ("管理", "management"), ("控制", "control"),
    ("执行", "execution"), ("调度", "scheduling"), ("路由", "routing"), ("转换", "transformation"),
    ("优化", "optimization"), ("缓存", "caching"), ("存储", "storage"), ("持久化", "persistence"),
    ("同步", "synchronization"), ("异步", "async"), ("并发", "concurrency"), ("测试", "testing"),
    ("调试", "debugging"), ("日志", "logging"), ("记录", "logging"), ("配置", "configuration"),
    ("设置", "configuration"), ("初始化", "initialization"), ("启动", "startup"),
    ("连接", "connection"), ("通信", "communication"), ("传输", "transmission"), ("发送", "sending"),
    ("接收", "receiving"), ("响应", "response"), ("请求", "request"), ("查询", "query"),
    ("搜索", "search"), ("过滤", "filtering"), ("排序", "sorting"), ("计算", "calculation"),
    ("统计", "statistics"), ("报告", "reporting"), ("展示", "display"), ("渲染", "rendering"),
    ("界面", "interface"), ("用户", "user"), ("系统", "system"), ("服务", "service"),
    ("模块", "module"), ("组件", "component"), ("工具", "utility"), ("帮助", "helper"),
    ("辅助", "auxiliary"), ("智能体", "agent"), ("代理", "agent"), ("工作流", "workflow"),
    ("任务", "task"), ("状态", "state"), ("决策", "decision"), ("策略", "strategy"), ("规则", "rule"),
    ("算法", "algorithm"), ("模型", "model"), ("数据", "data"), ("消息", "message"), ("事件", "event"),
    ("队列", "queue"), ("栈", "stack"), ("树", "tree"), ("图", "graph"), ("网络", "network"),
    ("协议", "protocol"), ("编码", "encoding"), ("解码", "decoding"), ("加密", "encryption"),
    ("安全", "security"), ("认证", "authentication"), ("授权", "authorization"),
    ("权限", "permission"), ("用户界面", "ui"), ("命令行", "cli"), ("命令", "command"),
    ("指令", "instruction"), ("脚本", "script"), ("文件", "file"), ("目录", "directory"),
    ("路径", "path"), ("资源", "resource"), ("内存", "memory"), ("性能", "performance"),
    ("效率", "efficiency"), ("速度", "speed"), ("时间", "time"), ("定时", "timer"), ("延迟", "delay"),
    ("错误", "error"), ("异常", "exception"), ("故障", "failure"), ("恢复", "recovery"),
    ("备份", "backup"), ("还原", "restore"), ("版本", "version"), ("更新", "update"),
    ("升级", "upgrade"), ("迁移", "migration"),
]
SPECIAL_PHRASES = [
    ("输入验证", "input_validation"), ("数据验证", "data_validation"), ("状态管理", "state_management"),
    ("任务管理", "task_management"), ("工作流管理", "workflow_management"),
    ("消息处理", "message_processing"), ("数据处理", "data_processing"), ("错误处理", "error_handling"),
    ("异常处理", "exception_handling"), ("性能监控", "performance_monitoring"),
    ("系统监控", "system_monitoring"), ("网络传输", "network_transmission"),
    ("文件操作", "file_operations"), ("数据库操作", "database_operations"),
    ("缓存管理", "cache_management"), ("配置管理", "configuration_management"), ("日志记录", "logging"),
    ("用户界面", "user_interface"), ("命令行界面", "cli_interface"), ("API接口", "api_interface"),
    ("数据分析", "data_analysis"), ("算法实现", "algorithm_implementation"),
    ("模型训练", "model_training"), ("结果展示", "result_display"), ("报告生成", "report_generation"),
]
ARCHITECTURE_NAMES = {
    "en": {"testing": "Testing Module", "api_layer": "API Layer", "data_model": "Data Model Layer",
           "service_layer": "Service Layer", "functional_module": "Functional Module",
           "controller": "Controller Layer", "view": "View Layer", "middleware": "Middleware",
           "adapter": "Adapter Pattern", "factory": "Factory Pattern", "observer": "Observer Pattern",
           "strategy": "Strategy Pattern", "decorator": "Decorator Pattern", "facade": "Facade Pattern",
           "proxy": "Proxy Pattern", "singleton": "Singleton Pattern"},
    "zh": {"testing": "测试模块", "api_layer": "API层", "data_model": "数据模型层", "service_layer": "服务层",
           "functional_module": "功能模块", "controller": "控制器层", "view": "视图层", "middleware": "中间件",
           "adapter": "适配器模式", "factory": "工厂模式", "observer": "观察者模式", "strategy": "策略模式",
           "decorator": "装饰器模式", "facade": "外观模式", "proxy": "代理模式", "singleton": "单例模式"},
}
# ---------------------------------------------------------------------------


def keyword_terms(lang: str = "en") -> list[tuple[str, str]]:
    """(term, keyword) in the order they count: description terms, then
    dictionary keywords, then phrases."""
    return [*DESCRIPTION_TERMS, *((w, w) for w in FUNCTION_WORDS[lang]),
            *((p.lower(), kw) for p, kw in SPECIAL_PHRASES)]


def extract_keywords(functionality, lang: str = "en", k: int = 2) -> Column:
    """F13 as an expression, for short texts: the terms found in the
    lower-cased text, first ``k`` distinct keywords."""
    low = F.lower(F.col(functionality) if isinstance(functionality, str) else functionality)
    found = [F.when(low.contains(t), F.lit(kw)) for t, kw in keyword_terms(lang)]
    return F.slice(F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull())), 1, k)


def with_keywords(df: DataFrame, functionality: str, lang: str = "en", k: int = 2,
                  out: str = "keywords") -> DataFrame:
    """F13 over long texts: ``df`` with the first ``k`` distinct keywords in
    ``out``.  One automaton of all terms reads each text once, whatever the
    number of terms.  Null text has none."""
    terms = keyword_terms(lang)
    places: dict[str, list[int]] = {}
    for i, (t, _) in enumerate(terms):
        places.setdefault(t, []).append(i)

    def run(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for t, at in places.items():
            automaton.add_word(t, at)
        automaton.make_automaton()

        def keywords(text):
            met = {i for _, at in automaton.iter(text or "") for i in at}
            return list(dict.fromkeys(terms[i][1] for i in sorted(met)))[:k]

        for b in batches:
            for i in range(0, b.num_rows, 256):
                cut = b.slice(i, 256)
                found = [keywords(t) for t in cut.column(cut.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*cut.columns[:-1], pa.array(found, pa.list_(pa.string()))], [*cut.schema.names[:-1], out])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.withColumn("_low", F.lower(functionality)).mapInArrow(run, f"{kept}, {out} array<string>")


def name_from_description(functionality, tags, pattern, lang: str = "en", keywords=None) -> Column:
    """keywords of the functionality → name; else the first two tags
    that are dictionary words (or the first tag title-cased); the
    architecture pattern only when there is neither text nor tags.
    ``keywords``: those of ``with_keywords``, if already there."""
    fn = F.col(functionality) if isinstance(functionality, str) else functionality
    tg = F.coalesce(F.col(tags) if isinstance(tags, str) else tags, F.array().cast("array<string>"))
    pt = F.col(pattern) if isinstance(pattern, str) else pattern
    kws = extract_keywords(fn, lang) if keywords is None else F.col(keywords)
    words = F.create_map(*[x for k2, v in FUNCTION_WORDS[lang].items() for x in (F.lit(k2), F.lit(v))])
    known = F.filter(F.slice(tg, 1, 2), lambda t: F.element_at(words, t).isNotNull())
    tag_name = F.when(F.size(known) > 0, F.concat(F.array_join(F.transform(known, lambda t: F.element_at(words, t)),
                                                               JOINER[lang]), F.lit(MODULE_SUFFIX[lang]))) \
        .otherwise(F.concat(title_case(F.element_at(tg, 1)), F.lit(MODULE_SUFFIX[lang])))
    arch = F.create_map(*[x for k2, v in ARCHITECTURE_NAMES[lang].items() for x in (F.lit(k2), F.lit(v))])
    has_text = F.coalesce(F.length(fn) > 0, F.lit(False))
    has_tags = (F.size(tg) > 0) & ~((F.size(tg) == 1) & (F.element_at(tg, 1) == "unknown"))
    return (F.when(has_text & (F.size(kws) > 0), build_name(kws, lang))
            .when(has_tags, tag_name)
            .when(~has_text & (F.size(tg) == 0) & pt.isNotNull() & (pt != "unknown"),
                  F.coalesce(F.element_at(arch, pt), pt)))
