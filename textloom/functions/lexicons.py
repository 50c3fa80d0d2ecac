"""Term lists as parameters: the Chinese lists that results depend on, and Latin-script lists for other corpora."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Lexicon:
    """All term lists and texts of the analysis; every operator takes one."""

    stopwords: tuple[str, ...]
    domains: tuple[tuple[str, tuple[str, ...]], ...]
    weighted_domains: tuple[tuple[str, float, tuple[str, ...]], ...]
    groups: tuple[tuple[str, tuple[str, ...]], ...]
    overlapping_groups: tuple[tuple[str, tuple[str, ...]], ...]
    remainder: str
    entities: tuple[tuple[str, tuple[str, ...]], ...]
    entity_patterns: tuple[tuple[str, tuple[str, ...]], ...]
    person_pattern: str
    organization_pattern: str
    domain_themes: tuple[tuple[str, str], ...]
    relations: tuple[tuple[str, tuple[str, ...]], ...]
    complexity: tuple[str, ...]
    delimiters: str
    delimiters_rich: str
    colon: str
    comma: str
    period: str
    default_title: str
    drop_ascii: bool = True
    texts: dict[str, str] = field(default_factory=dict)


# Results on Chinese texts follow from these lists.
ZH = Lexicon(
    stopwords=(
        "的", "是", "在", "有", "和", "就", "不", "了", "与", "也", "上", "为", "个", "我", "你", "他", "她", "它", "这", "那", "其", "之", "以", "及", "等", "很", "更", "最", "还", "都", "要", "可", "能",
        "会", "而", "但", "或", "如", "若", "因", "由", "对", "从", "到", "把", "被", "让", "使", "给", "向", "往", "一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "百", "千", "万", "年", "月", "日",
    ),
    domains=(
        ("technology", ("技术", "软件", "开发", "编程", "代码", "系统", "平台", "工具", "AI", "算法", "数据", "网络")),
        ("business", ("商业", "营销", "管理", "创业", "投资", "品牌", "策略", "运营", "市场", "销售")),
        ("education", ("教育", "学习", "培训", "课程", "知识", "技能", "方法", "思维", "成长", "发展")),
        ("lifestyle", ("生活", "健康", "美食", "旅行", "时尚", "文化", "艺术", "娱乐", "运动", "心理")),
        ("finance", ("金融", "投资", "理财", "股票", "基金", "保险", "贷款", "财务", "经济", "货币")),
    ),
    weighted_domains=(
        ("technology", 1.0, (
            "编程", "开发", "代码", "程序", "软件", "技术", "算法", "架构", "系统", "平台", "AI", "人工智能", "机器学习", "深度学习", "Python", "Java", "JavaScript", "前端", "后端", "数据库", "网络",
            "云计算", "大数据", "区块链", "工具", "IDE", "API", "框架", "库", "开源", "Github", "版本控制", "测试", "部署", "运维",
        )),
        ("business", 1.0, (
            "商业", "创业", "营销", "销售", "客户", "市场", "品牌", "运营", "策略", "商务", "合作", "竞争", "产品", "服务", "用户", "体验", "需求", "痛点", "商业模式", "盈利", "收入", "成本", "效率",
            "增长", "扩张", "转型", "创新", "商业计划",
        )),
        ("finance", 1.0, (
            "金融", "投资", "理财", "股票", "基金", "债券", "证券", "期货", "保险", "银行", "资产", "财富", "收益", "风险", "回报", "资本", "融资", "上市", "IPO", "估值", "财务", "会计", "预算", "现金流",
            "利润", "成本", "税务", "审计", "报表",
        )),
        ("management", 1.0, (
            "管理", "领导", "团队", "组织", "人事", "招聘", "培训", "绩效", "考核", "激励", "沟通", "协作", "决策", "执行", "监督", "反馈", "改进", "文化", "价值观", "愿景", "使命", "战略", "规划", "目标",
            "KPI", "OKR", "流程", "制度", "规范",
        )),
        ("education", 1.0, (
            "教育", "学习", "培训", "课程", "教学", "知识", "技能", "能力", "素质", "方法", "技巧", "经验", "实践", "理论", "原理", "概念", "思维", "认知", "理解", "掌握", "提升", "成长", "发展", "进步",
            "突破", "创新", "思考", "分析", "解决", "应用",
        )),
        ("personal_development", 1.0, (
            "职业", "发展", "成长", "规划", "目标", "习惯", "思维", "心理", "情商", "沟通", "人际关系", "社交", "影响力", "自信", "自律", "时间管理", "效率", "专注", "学习能力", "适应能力", "创造力",
            "执行力", "领导力", "决策力", "抗压力",
        )),
        ("lifestyle", 0.8, (
            "生活", "健康", "饮食", "运动", "健身", "美食", "旅行", "娱乐", "休闲", "兴趣", "爱好", "家庭", "朋友", "社交", "时尚", "购物", "消费", "家居", "装修", "文化",
        )),
    ),
    groups=(("method", ("方法", "技巧", "策略", "方式")), ("tool", ("工具", "软件", "平台", "系统")), ("application", ("应用", "实践", "使用", "操作"))),
    overlapping_groups=(
        ("技术方法", ("技术", "方法", "工具", "系统", "平台")), ("核心概念", ("概念", "理论", "原理", "思维", "模式")),
        ("实践应用", ("实践", "应用", "操作", "执行", "实施")), ("管理策略", ("管理", "策略", "规划", "组织", "团队")),
    ),
    remainder="其他关键点",
    entities=(
        ("organization", ("公司", "组织", "机构", "平台")), ("tool", ("工具", "软件", "系统", "平台")),
        ("skill", ("技能", "能力", "方法", "技术")), ("concept", ("概念", "理论", "模式", "原理")),
    ),
    entity_patterns=(
        ("person", ("老师", "专家", "博士", "教授", "创始人", "总裁", "CEO", "CTO", "经理", "主管", "同事", "朋友")),
        ("organization", ("公司", "企业", "机构", "组织", "团队", "部门", "学校", "大学", "研究院", "实验室")),
        ("concept", ("方法", "技巧", "策略", "原理", "理论", "模式", "框架", "体系", "流程", "步骤")),
        ("tool", ("工具", "软件", "平台", "系统", "应用", "程序", "设备", "技术")),
        ("skill", ("技能", "能力", "经验", "知识", "素质", "水平", "实力", "专业")),
        ("goal", ("目标", "目的", "计划", "规划", "愿景", "梦想", "期望", "成果")),
    ),
    person_pattern=r"[A-Za-z]+(?:\s+[A-Za-z]+)*|[一-鿿]{2,4}(?:老师|专家|博士|教授|总裁|CEO|经理)",
    organization_pattern=r"[一-鿿]+(?:公司|企业|集团|科技|技术|系统|平台|机构|组织|大学|学院)",
    domain_themes=(("technology", "技术创新与应用"), ("business", "商业策略与运营"), ("education", "学习成长与发展"), ("lifestyle", "生活方式与文化"), ("finance", "金融理财与投资")),
    relations=(
        ("cause_effect", ("因为", "所以", "导致", "造成", "引起", "产生", "带来", "结果", "影响")),
        ("comparison", ("比较", "对比", "相比", "不同", "相同", "区别", "差异", "优势", "劣势")),
        ("sequence", ("首先", "然后", "接着", "最后", "步骤", "阶段", "过程", "顺序", "流程")),
        ("method", ("方法", "技巧", "策略", "方式", "手段", "途径", "办法", "措施", "方案")),
        ("importance", ("重要", "关键", "核心", "主要", "关键点", "要点", "重点", "焦点")),
    ),
    complexity=("高级", "复杂", "深入", "专业", "技术"),
    delimiters="。！？\n",
    delimiters_rich="。！？；\n",
    colon="：",
    comma="，",
    period="。",
    default_title="未知标题",
    texts={
        "title_theme": "：核心主题", "domain_theme": "：领域主题", "keyword_theme": "相关应用：实践主题", "relation_theme": "相关内容：",
        "brief": "关于{}的简要内容。", "around": "主要内容围绕{}展开，涉及{}等关键概念。", "about": "内容主要讨论{}相关话题。", "too_short": "内容过短，无法进行有效分析",
    },
)

LATIN = Lexicon(
    stopwords=("the", "of", "and", "de", "la", "der", "die", "en", "un", "los", "que", "in", "to", "is", "el", "le", "und", "les", "das", "es", "to", "on", "or"),
    domains=(("technology", ("tion", "ingth")), ("business", ("ment", "que")), ("education", ("keit", "lich")), ("lifestyle", ("ción", "mente")), ("finance", ("ble", "ndly"))),
    weighted_domains=(("technology", 1.0, ("tion", "rethi", "ingin")), ("education", 1.0, ("keit", "lich", "schau")), ("business", 1.0, ("ment", "eux")), ("lifestyle", 0.8, ("ción", "mente", "dolos"))),
    groups=(("method", ("ing", "ung")), ("tool", ("er", "eux")), ("application", ("tion", "ción"))),
    overlapping_groups=(("craft", ("ing", "ung", "ment")), ("idea", ("tion", "keit", "ción")), ("practice", ("er", "oi")), ("plan", ("ly", "lich"))),
    remainder="rest",
    entities=(("organization", ("tion", "ción")), ("tool", ("er", "ung")), ("skill", ("ing", "ment")), ("concept", ("th", "que", "ch"))),
    entity_patterns=(("person", ("ers", "the")), ("organization", ("tion", "ung")), ("concept", ("ing", "que")), ("tool", ("ble", "oi")), ("skill", ("ment", "lich")), ("goal", ("ra", "st"))),
    person_pattern=r"[A-Z][a-z]+(?: [A-Z][a-z]+)+",
    organization_pattern=r"[A-Za-z]+(?:tion|ung|ment)",
    domain_themes=(("technology", "technology and use"), ("business", "business and plans"), ("education", "learning and growth"), ("lifestyle", "life and culture"), ("finance", "money and markets")),
    relations=(("cause_effect", ("and", "und")), ("comparison", ("than", "que")), ("sequence", ("first", "then ")), ("method", ("ing", "mit")), ("importance", ("was", "les "))),
    complexity=("tion", "keit", "ment", "ción", "ing"),
    delimiters=".!?\n",
    delimiters_rich=".!?;\n",
    colon=":",
    comma=",",
    period=".",
    default_title="untitled",
    drop_ascii=False,
    texts={
        "title_theme": ": main theme", "domain_theme": ": field", "keyword_theme": " in use: practice", "relation_theme": " content:",
        "brief": "A short text on {}.", "around": "Mainly about {}, with {} among its terms.", "about": "Mainly about {}.", "too_short": "Too short to analyse.",
    },
)
