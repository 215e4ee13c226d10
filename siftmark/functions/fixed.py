"""The builtin rules, words and labels whose results must equal the published ones."""

# Name, RE2 pattern, risk.
BUILTIN_RULES = (
    ("id_card", r"\b\d{17}[\dXx]\b", "high"),
    ("mobile_phone", r"\b1[3-9]\d{9}\b", "medium"),
    ("bank_card", r"\b\d{16,19}\b", "high"),
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", "medium"),
    ("license_plate", r"[一-龥][A-Z][A-Z0-9]{5,6}", "medium"),
    ("passport", r"[EGPSeps][0-9]{7,8}", "medium"),
    ("social_security", r"(?i)(社保|社会保障|social security).{0,12}\b\d{9,18}\b", "high"),
    ("tax_number", r"(?i)(税号|纳税人识别号|tax).{0,12}[A-Z0-9]{15,20}", "high"),
    ("credit_code", r"[0-9A-HJ-NPQRTUWXY]{18}", "high"),
    ("contract_number", r"(?i)(合同编号|合同号|contract[ _-]?(no|id|number)).{0,12}[A-Za-z0-9\-_]{6,}", "medium"),
    ("address", r"[一-龥]{2,}(省|市|区|县|镇|乡|街道|路|街|号|栋|单元|室)", "medium"),
    ("private_ip", r"\b(10\.\d{1,3}|172\.(1[6-9]|2\d|3[0-1])|192\.168)\.\d{1,3}\.\d{1,3}\b", "medium"),
    ("domain", r"\b([A-Za-z0-9\-]+\.)+[A-Za-z]{2,}\b", "low"),
    ("api_key", r'(?i)(api[_-]?key|access[_-]?token|secret)[\s:=\"]+[A-Za-z0-9_\-.]{16,}', "high"),
    ("access_token", r'(?i)(access[_-]?token|bearer)[\s:=\"]+[A-Za-z0-9._\-]{20,}', "high"),
    ("private_key", r"-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----", "critical"),
    ("password", r'(?i)(password|passwd|pwd)[\s:=\"]+[^\s\"]{6,}', "high"),
    ("db_connection", r"(?i)(jdbc:mysql|postgresql://|mongodb://|redis://)", "high"),
    ("money_wan", r"\d+(\.\d+)?万元", "medium"),
)

# Words that count as business terms in keyword extraction.
BUSINESS_TERMS = (
    "客户名称", "客户名单", "联系人", "联系方式", "报价", "报价单", "合同", "合同编号", "合同金额", "未公开", "保密", "不得披露", "财务", "预算", "薪资", "工资", "奖金", "绩效", "战略规划", "商业计划", "招投标",
    "投标", "源代码", "漏洞", "运维账号", "数据库密码", "内部接口", "系统架构", "研发设计", "财报", "成本", "利润", "API Key", "access token", "履约保证金", "付款节点", "验收条款", "违约责任", "甲方",
    "乙方", "未公开财报", "内部培训资料", "研发设计文档",
)

# Words that are never keywords.
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
    "那", "他", "她", "它", "们", "什么", "为", "所以", "因为", "但是", "可以", "这个", "那个", "进行", "使用", "以及", "通过", "需要", "文件", "文档", "内容", "信息", "数据", "资料", "包含",
    "相关", "the", "and", "this", "that", "with", "for", "from", "have", "has",
)

# Combined templates as name, keywords, least hits, RE2 pattern, risk, triggers.
TEMPLATES = (
    ("客户报价组合识别", ("客户名称", "报价", "合同金额", "联系人"), 2, r"\d+(\.\d+)?万元", "high", ("客户", "报价", "合同金额", "联系人")),
    ("财务预算组合识别", ("财务", "预算", "成本", "利润", "财报"), 2, r"\d+(\.\d+)?(万元|元|%)", "high", ("财务", "预算", "成本", "利润", "财报")),
    ("薪资绩效组合识别", ("薪资", "工资", "奖金", "绩效", "员工"), 2, r"\d+(\.\d+)?(万元|元)", "high", ("薪资", "工资", "奖金", "绩效")),
    ("源码泄露组合识别", ("源代码", "接口", "函数", "数据库密码", "内部接口"), 2, r'(?i)(api[_-]?key|password|passwd|secret|token)[\s:=\"]+[^\s\"]{6,}', "critical", ("源代码", "接口", "数据库密码", "内部接口")),
    ("合同保密组合识别", ("合同", "合同编号", "合同金额", "保密", "不得披露"), 2, r"(?i)(合同编号|合同号|contract[ _-]?(no|id|number)).{0,12}[A-Za-z0-9\-_]{6,}", "high", ("合同", "合同编号", "合同金额", "保密")),
)

# Semantic labels and the words that hint at them.
LABEL_HINTS = {
    "客户名单": ("客户", "联系人", "客户名称", "名单", "电话", "邮箱", "手机"),
    "报价信息": ("报价", "报价单", "合同金额", "万元", "价格", "单价", "总价"),
    "财务预算": ("财务", "预算", "成本", "利润", "财报", "营收", "报表"),
    "薪资明细": ("薪资", "工资", "奖金", "绩效", "社保", "个税"),
    "保密协议": ("保密", "协议", "不得披露", "商业机密"),
    "研发设计文档": ("研发", "设计", "架构", "技术方案", "系统架构"),
    "源代码说明": ("源代码", "源码", "接口", "函数", "数据库连接", "api_key"),
    "内部培训资料": ("内部培训", "培训资料", "课件", "培训"),
    "未公开财报": ("未公开财报", "财报", "未公开", "利润", "营收"),
    "运维账号": ("账号", "密码", "token", "secret", "运维", "内网", "ssh"),
    "安全漏洞信息": ("漏洞", "CVE", "修复", "攻击"),
    "战略规划": ("战略", "规划", "商业计划", "未公开"),
}
# Labels that make a sample high-risk, levels in ascending order, and names of results.
HIGH_RISK_LABELS = ("运维账号", "安全漏洞信息", "客户名单", "报价信息")
RISKS = ("info", "low", "medium", "high", "critical")
CONFIDENCE = ("clean", "low_confidence", "suspected", "sensitive")

UNCLASSIFIED = "未分类敏感文件"
KEYWORD_RULE = "关键词识别"
EXPLANATION = ("文档命中敏感样本规则, 包含", "等敏感语义或业务关键词.")
PLACEHOLDER = "[二进制文件: %s, 大小: %d bytes]"
SAMPLE_HIT = "样本指纹命中"

# File kinds by suffix, and folders that a scan leaves out.
UNSUPPORTED = (".ppt", ".pptx", ".doc", ".xls", ".png", ".jpg", ".jpeg", ".bmp", ".gif", ".tiff", ".eml", ".msg")
SKIP_DIRS = (".git", ".hg", ".svn", ".venv", "venv", "node_modules", "__pycache__", "dist", "build", "target", "out", ".mypy_cache", ".pytest_cache", ".idea", ".vscode")

# Fixed value: the prompt for an optional language model.
PROMPT = """请分析以下文档内容, 判断其是否包含敏感信息, 并返回 JSON 格式的分析结果.

请严格按照以下 JSON 格式返回(不要包含 markdown 代码块或其他文字):
{
  "semantic_labels": ["标签1", "标签2"],
  "sensitive_type": "敏感类型分类",
  "risk_level": "high/medium/low",
  "explanation": "判断依据的简要说明"
}

可选语义标签: 客户名单, 报价信息, 财务预算, 薪资明细, 保密协议, 研发设计文档, 源代码说明, 运维账号, 安全漏洞信息, 战略规划. 也可以根据内容添加新标签.
风险等级规则: 包含账号密码/密钥/漏洞信息为 high, 包含客户/报价/薪资/财务/战略为 high, 包含一般业务关键词为 medium, 仅少量命中的为 low.

用户提示 - 敏感类型: {{SENSITIVE_TYPE}}, 风险等级: {{RISK_LEVEL}}

文档内容:
{{DOCUMENT_TEXT}}
"""
