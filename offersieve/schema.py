"""Fixed values of the offer-list domain: fields, enumerations, dictionaries, quality codes.

These must equal what users' files and earlier reports hold, so they are stated
plainly, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------- enumerations (fixed values)
UNKNOWN, OTHER = "未知", "其他"
JOINED, PENDING, APPROVING, REJECTED, REJECTED_VERBALLY = "已入职", "待入职", "offer审批中", "拒绝offer", "拒绝口头offer"
OFFER_STATUSES = (JOINED, PENDING, APPROVING, REJECTED, REJECTED_VERBALLY, OTHER, UNKNOWN)
ACCEPTED = (JOINED, PENDING)
REJECTIONS = (REJECTED, REJECTED_VERBALLY)
CORE = (JOINED, PENDING, REJECTED, REJECTED_VERBALLY)
UNSPLIT = "替补替换未拆分"
REQUIREMENT_TYPES = ("新增招聘", "替补", "替换", UNSPLIT, OTHER, UNKNOWN)
TARGET_CITIES = ("上海", "广州", "杭州")
CITIES = (*TARGET_CITIES, OTHER, UNKNOWN)
CHANNELS = ("官网", "Boss", "实习僧", "内推", OTHER, UNKNOWN)
REFERRAL = "内推"
REFERRAL_TYPES = (REFERRAL, "HR推", OTHER, UNKNOWN)
NO_SUBSIDY, CASH, LODGING = "无补贴", "现金房补", "提供住宿"
HOUSING_TYPES = (NO_SUBSIDY, CASH, LODGING, OTHER, UNKNOWN)
HOUSING_PERIODS = ("月", "天", "次", OTHER)
EDUCATIONS = ("专科", "本科", "硕士", "博士", OTHER, UNKNOWN)
IMPORT_MODES = ("新建快照", "替换当前数据集", "追加")
KEEP_ALL, KEEP_FIRST = "保留全部", "确认后每组保留首条"
YES, NO = "是", "否"
#: option -> (currency, unit, comparable)
SALARY_UNITS = {
    "人民币元/月": ("CNY", "元/月", True),
    "人民币元/天": ("CNY", "元/天", True),
    OTHER: (OTHER, OTHER, False),
    "暂不确定": (None, None, False),
}
#: A salary unit's period, for adding up salary and housing.
UNIT_PERIODS = {"元/月": "月", "元/天": "天"}

# ---------------------------------------------------------------- fields (fixed values)
#: key, header, kind, aliases, sensitive
STANDARD_FIELDS = (
    ("requirementId", "需求ID", "text", (), False),
    ("recruiter", "招聘HR", "text", ("招聘负责人", "招聘专员"), True),
    ("city", "城市", "enum", ("工作城市", "工作地点"), False),
    ("department", "一级部门", "text", ("部门", "事业部"), False),
    ("position", "岗位", "text", ("职位", "岗位名称"), False),
    ("jobFamily", "序列", "text", ("职位序列", "岗位序列"), False),
    ("requirementType", "需求类型", "enum", ("需求性质",), False),
    ("recruitmentStartDate", "启动招聘时间", "date", ("招聘启动日期", "启动日期"), False),
    ("joiningDate", "入职时间", "date", ("到岗日期", "入职日期"), False),
    ("expectedEndDate", "预计离职时间", "date", ("预计离职日期",), False),
    ("candidateName", "姓名", "text", ("候选人姓名", "学生姓名"), True),
    ("graduationYear", "毕业年级", "year", ("毕业年份", "毕业年度"), False),
    ("education", "学历", "enum", ("最高学历",), False),
    ("school", "学校", "text", ("毕业院校", "就读院校"), True),
    ("isGptSchool", "是否GPT院校", "triState", (), False),
    ("referrer", "简历推荐人", "text", ("推荐人", "简历来源人"), True),
    ("channel", "渠道", "enum", ("招聘渠道", "来源渠道"), False),
    ("salaryAmount", "薪资", "amount", ("offer薪资",), True),
    ("housingRaw", "房补", "rawText", ("住房补贴", "房补说明"), True),
    ("offerStatus", "offer状态", "enum", ("offer进度",), False),
    ("rejectionReason", "拒绝原因分类", "text", ("拒offer原因", "拒绝原因"), False),
)
STANDARD_HEADERS = tuple(f[1] for f in STANDARD_FIELDS)
STANDARD_KEYS = tuple(f[0] for f in STANDARD_FIELDS)
SENSITIVE_FIELDS = tuple(f[0] for f in STANDARD_FIELDS if f[4])
REQUIRED_FIELDS = ("offerStatus",)
#: key, header, kind
EXTENSION_FIELDS = (
    ("offerId", "offer唯一ID", "text"),
    ("candidateInternalId", "候选人内部ID", "text"),
    ("offerSentDate", "offer发出日期", "date"),
    ("offerAcceptedDate", "offer接受日期", "date"),
    ("offerRejectedDate", "offer拒绝日期", "date"),
    ("plannedJoiningDate", "计划入职日期", "date"),
    ("actualJoiningDate", "实际入职日期", "date"),
    ("statusUpdatedAt", "状态更新时间", "date"),
    ("salaryCurrency", "薪资币种", "text"),
    ("salaryPeriod", "计薪周期", "text"),
    ("housingPeriodValue", "房补周期", "text"),
    ("housingValue", "住宿价值", "amount"),
    ("requirementTypeDetail", "需求类型细分", "text"),
    ("primaryRejectionReason", "主拒绝原因", "text"),
    ("rejectionReasonSource", "原因来源", "text"),
    ("referralTypeColumn", "推荐类型", "text"),
    ("requirementOpenDate", "需求开放时间", "date"),
    ("requirementCloseDate", "需求关闭时间", "date"),
    ("plannedHc", "计划HC", "amount"),
    ("actualEndDate", "实际离职时间", "date"),
    ("postJoiningStatus", "到岗后状态", "text"),
)
#: (header, field): a header that must not be mapped to a field by itself.
FORBIDDEN_PAIRS = (
    ("学位", "education"),
    ("推荐人", "recruiter"),
    ("简历推荐人", "recruiter"),
    ("招聘负责人", "referrer"),
    ("招聘HR", "referrer"),
    ("offer接受时间", "joiningDate"),
    ("入职时间", "offerAcceptedDate"),
)
#: Sample row of the template.
TEMPLATE_SAMPLE = (
    "REQ-0001", "HR样例", "上海", "示例事业部", "数据分析实习生", "数据", "新增招聘", "2026-05-08", "2026-08-03", "2026-12-06",
    "候选人样例", "2027", "本科", "样例大学", "否", "内推", "Boss", "4000", "无（本地院校）", "待入职", "",
)

# ---------------------------------------------------------------- value dictionaries (fixed values)
NULL_TOKENS = ("", "-", "--", "—", "N/A", "NA", "null", "无数据")
CITY_WORDS = {"上海": "上海", "广州": "广州", "杭州": "杭州", "上海青浦": "上海", "广州网易大厦": "广州", "杭州二园区": "杭州"}
STATUS_WORDS = {
    "已入职": JOINED, "待入职": PENDING, "offer审批中": APPROVING, "offer 审批中": APPROVING, "审批中": APPROVING, "已送审批": APPROVING,
    "拒绝offer": REJECTED, "拒绝 offer": REJECTED, "拒绝口头offer": REJECTED_VERBALLY, "拒绝口头 offer": REJECTED_VERBALLY,
    "其他": OTHER, "未知": UNKNOWN, "离职": OTHER, "已离职": OTHER, "撤回": OTHER, "已撤回": OTHER, "取消": OTHER, "取消入职": OTHER,
}
CHANNEL_WORDS = {"官网": "官网", "boss": "Boss", "实习僧": "实习僧", "内推": "内推", "其他": OTHER, "未知": UNKNOWN}
REQUIREMENT_WORDS = {
    "新增招聘": "新增招聘", "新增": "新增招聘", "替补": "替补", "替换": "替换", "其他": OTHER, "未知": UNKNOWN,
    "替补/替换": UNSPLIT, "替补替换": UNSPLIT, "替补替换未拆分": UNSPLIT,
}
EDUCATION_WORDS = {"专科": "专科", "大专": "专科", "本科": "本科", "硕士": "硕士", "研究生": "硕士", "博士": "博士", "其他": OTHER, "未知": UNKNOWN}
TRI_STATE_WORDS = {"是": True, "y": True, "yes": True, "true": True, "1": True, "否": False, "n": False, "no": False, "false": False, "0": False}
REASON_CATEGORIES = ("薪酬", "住房/住宿", "其他offer", "岗位内容", "地点", "实习时间", "学业安排", "个人原因", "其他", "未分类", "未填写")
UNCLASSIFIED, UNFILLED = "未分类", "未填写"
REASON_WORDS = {
    "薪酬": "薪酬", "住房/住宿": "住房/住宿", "住宿": "住房/住宿", "住房": "住房/住宿", "其他offer": "其他offer", "岗位内容": "岗位内容",
    "地点": "地点", "实习时间": "实习时间", "学业安排": "学业安排", "个人原因": "个人原因", "其他": "其他",
    "薪资": "薪酬", "薪资不满意": "薪酬", "薪酬不满意": "薪酬", "工资低": "薪酬", "待遇不满意": "薪酬",
    "房补": "住房/住宿", "住房补贴": "住房/住宿", "无补贴": "住房/住宿", "住宿问题": "住房/住宿",
    "有其他offer": "其他offer", "拿到其他offer": "其他offer", "其他机会": "其他offer",
    "工作内容不符": "岗位内容", "岗位不匹配": "岗位内容", "工作地点": "地点", "通勤": "地点", "距离太远": "地点",
    "时间不合适": "实习时间", "实习时间不合适": "实习时间", "开学": "学业安排", "课程冲突": "学业安排", "学业": "学业安排",
    "个人": "个人原因", "家庭原因": "个人原因", "身体原因": "个人原因",
}

# ---------------------------------------------------------------- quality codes and modules (fixed values)
BLOCKING, FIELD_ERROR, WARNING = "阻断", "字段错误", "警告"
ISSUE_SEVERITY = {
    **dict.fromkeys(("PARSE_FAILED", "UNSUPPORTED_FILE_TYPE", "ENCODING_FAILED", "EMPTY_DATASET", "MISSING_OFFER_STATUS_COLUMN", "FIELD_CONFLICT", "LIMIT_EXCEEDED"), BLOCKING),
    **dict.fromkeys(("INVALID_DATE", "NEGATIVE_CYCLE", "INVALID_SALARY"), FIELD_ERROR),
    **dict.fromkeys(
        (
            "VALUE_RANGE_UNCERTAIN", "HOUSING_VALUE_UNCERTAIN", "DATE_NOT_CONVERTED", "FORMULA_WITHOUT_CACHE", "QUOTE_MISMATCH", "UNKNOWN_ENUM_VALUE",
            "MISSING_REQUIRED_VALUE", "CYCLE_TOO_LONG", "EXACT_DUPLICATE", "SUSPECTED_DUPLICATE", "HEADER_ECHO_CELL", "PLANNED_DATE_UNCERTAIN",
            "SALARY_UNIT_UNCONFIRMED", "GPT_SOURCE_CONFLICT", "CHANNEL_INFERRED_FROM_REFERRER", "CHANNEL_REFERRER_CONFLICT",
            "MANUAL_CORRECTION_APPLIED", "EMPTY_SHEET_SKIPPED", "EMPTY_ROW_SKIPPED",
        ),
        WARNING,
    ),
}
MODULES = ("核心率", "审批中占比", "招聘周期", "薪资对比", "房补对比", "拒offer原因", "城市对比", "渠道对比", "HR效能", "画像分析", "需求分析")
ISSUE_DISABLES = {
    "MISSING_OFFER_STATUS_COLUMN": MODULES,
    "SALARY_UNIT_UNCONFIRMED": ("薪资对比", "房补对比"),
    "INVALID_SALARY": ("薪资对比",),
    "VALUE_RANGE_UNCERTAIN": ("薪资对比",),
    "UNKNOWN_ENUM_VALUE": ("房补对比", "渠道对比"),
}
SCHEMA_VERSION = RULES_VERSION = "1.0.0"

# ---------------------------------------------------------------- grouping
DIMENSIONS = {
    "city": "城市", "channel": "渠道", "referral_type": "推荐类型", "recruiter": "招聘HR", "position": "岗位", "job_family": "序列",
    "department": "一级部门", "requirement_type": "需求类型", "graduation_year": "毕业年级", "education": "学历", "school": "学校",
    "is_gpt": "GPT", "housing_type": "房补类型", "salary_band": "薪资区间",
}

#: Value columns of a clean record.
RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()), T.StructField("source_row", T.IntegerType()),
        *[T.StructField(c, T.StringType()) for c in ("requirement_id", "recruiter", "city", "city_raw", "department", "position", "job_family", "requirement_type")],
        *[T.StructField(c, T.DateType()) for c in ("start_date", "join_date", "end_date")],
        T.StructField("candidate_name", T.StringType()), T.StructField("graduation_year", T.IntegerType()),
        T.StructField("education", T.StringType()), T.StructField("school", T.StringType()), T.StructField("is_gpt", T.BooleanType()),
        *[T.StructField(c, T.StringType()) for c in ("referrer", "referral_type", "channel", "channel_raw")],
        T.StructField("salary_amount", T.DoubleType()), T.StructField("currency", T.StringType()), T.StructField("salary_unit", T.StringType()),
        T.StructField("housing_raw", T.StringType()), T.StructField("housing_type", T.StringType()), T.StructField("housing_amount", T.DoubleType()),
        T.StructField("housing_period", T.StringType()), T.StructField("offer_status", T.StringType()), T.StructField("rejection_reason", T.StringType()),
        T.StructField("dedup_action", T.StringType()),
    ]
)
