"""Character sets, word lists, patterns and formats that results depend on.

Everything in this module is data.  Rule packs for other languages are passed as parameters.
"""

# --- fixed values: characters -------------------------------------------------
#: what str.isspace() calls white space, without the information separators
SPACES = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
INVISIBLE = "\u200b\u200c\u200d\ufeff\u2060\u00ad\u034f"
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff\u2060"
BINDING_CHARS = "裝订訂装線线"
BINDING_CHARS_WIDE = "裝订訂装定線线"
CJK = "一-鿿"
CJK_PUNCT = "。，、：；（）()《》【】「」『』—－─"
NOISE_CHARS = r"\.\·•・‧∙⋯…,_\-—–=~\*\+|<>〈〉《》【】〔〕［］\[\]{}（）\(\)○、，。；：:?!？！／/\\‧‥^`'\" "
END_PUNC = "。！？；：…】）〉》』」"
SENTENCE_END = "[。！？!?；;]"
CLOSERS = "」』”’›》〉）】"

# --- fixed values: file encodings, in the order they are tried ----------------
ENCODINGS = ["utf-8-sig", "utf-8", "cp950", "big5", "gb18030", "utf-16", "utf-16le", "utf-16be"]
CSV_ENCODINGS = ["utf-8-sig", "utf-8", "cp950"]

# --- fixed values: line rules -------------------------------------------------
KEEP_LINE = [
    r"(法院|地方法院|高等法院|最高法院|行政執行署|執行處)",
    r"(主旨|主文|說明|理由|依據)\s*[:：]",
    r"(檔號|檔 案 號|檔案號)\s*[:：]",
    r"(保存年限|保存期限)\s*[:：]",
    r"(受文者|受文機關)\s*[:：]",
    r"(發文字號|發文日期|來文日期|來文字號|文號)\s*[:：]",
    r"(地址|聯絡地址)\s*[:：]",
    r"(電話|聯絡方式|傳真|承辦人)\s*[:：]",
    r"(案號|字號|字第)\s*[:：]?",
    r"(執行命令|扣押命令|撤銷令|收取令|通知函)",
    r"(?:^|[^\p{L}\p{N}_])[0-9]{2,3}[./-][0-9]{1,2}[./-][0-9]{1,2}(?:$|[^\p{L}\p{N}_])",
    r"(?:中華民國)?\s*[0-9]{3,4}\s*年\s*[0-9]{1,2}\s*月\s*[0-9]{1,2}\s*日",
    r"(?:司執|家執|保字|金管)\S*第?\s*\d+\s*號",
    r"字第\s*\d+\s*號",
    r"(?:^|[^\p{L}\p{N}_])[A-Z][12]\d{8}(?:$|[^\p{L}\p{N}_])",
]
PAGE_LINE = [
    r"^第\s*\d+\s*頁(?:\s*/\s*共\s*\d+\s*頁)?\s*$",
    r"^(?i:Page)\s*\d+(?:\s*/\s*\d+)?\s*$",
    r"^\s*-+\s*\d+\s*-+\s*$",
    r"^\s*_{2,}\s*$",
]
PAGE_MARKER_STRICT = r"^第\s*\d+\s*頁\s*[,，、]?\s*共\s*\d+\s*頁$"
PAGE_MARKER_LOOSE = r"^第\s*\d+\s*頁.*共\s*\d+\s*頁$"
PARAGRAPH_HEAD = (
    r"^\s*(?:[（(]?[一二三四五六七八九十][)）、\.．]|[0-9]{1,2}[)\.、．]|[一二三四五六七八九十]+、"
    r"|主旨|主文|說明|理由|依據|檔號|保存年限|受文者|發文字號|發文日期|地址|電話|傳真|案號|字號)\s*[:：]?"
)
SECTION_HEAD = r"^((主旨|說明|附件|備註|結論|參考|辦法|依據)\s*[:：]|[（(]?[一二三四五六七八九十][)）]|[一二三四五六七八九十]+、|\d+、)"
VERTICAL_WORDS = ["裝訂線", "撕裂線", "裝訂處"]
WRAP_END = r"[。！？：；、,:;)\]\}＞>」』]$"
WRAP_BULLET = r"^([\-–—•\*•]|第[一二三四五六七八九十]條|\d+[\.\)]|\(一\))"
SEPARATOR_LINE = r"^(?:-{3,}|_{3,}|=+|~+|\d+/\d+|第\d+頁)$"
KEEP_WORDS = [
    "函", "主旨", "電話", "聯絡電話", "聯絡方式", "附件", "地址", "承辦人", "傳真",
    "發文日期", "發文字號", "速別", "說明", "正本", "副本",
    "受文者", "檔號", "保存年限", "保存期限", "受文單位", "受文機關", "案號", "字號",
    "發文機關", "承辦單位", "核稿", "會簽", "簽發", "來文", "來文字號", "收文日期",
    "機關地址", "機關電話", "頁次",
    "一", "二", "三", "四", "五", "六", "七", "八", "九", "十",
]
BANNED_LINE = [
    r"^\s*$",
    r"^[\.\·\•\*]{2,}\s*$",
    r"^[\.\s]+$",
    r"^\s*(裝|訂|線)\s*$",
    r"^第\s*\d+\s*頁\s*[，,、]?\s*共\s*\d+\s*頁\s*$",
    r"^[\-_]{3,}\s*$",
]

# --- fixed values: ordered replacements (pattern, replacement) ----------------
INLINE_NOISE = [
    (rf"[^\p{{L}}\p{{N}}_\s{CJK_PUNCT}]{{2,}}", " "),
    (r"[\^ˇ＾~`\\/|<>]+", ""),
    (rf"(?<![\p{{L}}\p{{N}}_])[A-Za-z]\s*[^0-9A-Za-z\s{CJK}]{{1,3}}\s*[A-Za-z](?![\p{{L}}\p{{N}}_])", ""),
    (rf"(?<=^|[\s{CJK}{CJK_PUNCT}])[A-Za-z](?=$|[\s{CJK}{CJK_PUNCT}])", ""),
    (r"\s{2,}", " "),
]
INLINE_NOISE_NARROW = [
    (rf"[^\p{{L}}\p{{N}}_\s{CJK_PUNCT}]{{2,}}", " "),
    (r"[\^ˇ＾~`\\/|<>]+", ""),
    (r"(?<![\p{L}\p{N}_])[A-Za-z]\s*[/\\|<>]\s*[A-Za-z](?![\p{L}\p{N}_])", ""),
    (rf"(?<=^|[\s{CJK}{CJK_PUNCT}])[A-Za-z](?=$|[\s{CJK}{CJK_PUNCT}])", ""),
    (r"\s{2,}", " "),
]
COLLAPSE_RUNS = [
    (r"[\.⋯…]{2,}", "……"),
    (r"[—–\-]{2,}", "—"),
    (r"\*{2,}", "*"),
    (r"_{2,}", "—"),
    (r"[ \t]{2,}", " "),
]
COLONS = [(r"[：﹕:]\s*", "：")]
DOT_NOISE = [(r"^[\.\s]+", ""), (r"(?:\s*\.\s*){3,}", " "), (r"(?:\s*\.\s*){2,}$", "")]
DOT_LADDERS = [(r"(?:\.\s*){3,}", "..."), ("．．．", "…"), ("… …", "…")]
BULLETS = [
    (r"^[\*\•\·]\s*", "・"),
    (r"^(\d+)[\)\.]\s?", "$1. "),
    (r"^[\(\（](\d+)[\)\）]\s*", "$1. "),
    (r"^[\(\（](一|二|三|四|五|六|七|八|九|十)[\)\）]\s*", "$1、"),
]
PUNCTUATION = [
    (r"[.]{2,}", "。"),
    (r"。{2,}", "。"),
    (r"[，,]{2,}", "，"),
    (r":", "："),
    (r"(?m)^\s*[,，。：;；]+", ""),
    (r"\(", "（"),
    (r"\)", "）"),
    (r"\[", "【"),
    (r"\]", "】"),
    (r'"', "”"),
    (r"'", "’"),
]
CONTROLS = [(r"[\x00-\x08\x0b-\x1f\x7f-\x9f\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]", " "), (r"[ \t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]+", " "), (r" *\n *", "\n")]
CORRECTIONS = [
    ("王旨", "主旨"), ("圭旨", "主旨"), ("說朋", "說明"), ("說眀", "說明"),
    ("：", ":"), ("﹕", ":"), ("︰", ":"), ("\u3000", " "), ("\ufeff", ""),
    ("－", "-"), ("—", "-"), ("–", "-"),
]
ENUMERATORS = [(r"\s*([一二三四五六七八九十]+、)", "\n$1"), (r"\n{3,}", "\n\n")]
LOOKALIKES = ("OIlZSB", "011258")
DETECTION_REMOVE = [(r"[，。、「」『』【】（）()\[\]\s]+", "")]

# --- fixed values: fields of letters ------------------------------------------
FIELD_PATTERNS = {
    "subject": r"(?:主旨|主文)\s*[:：]\s*(.+)",
    "desc": r"(?s)(?:說明|理由)\s*[:：]\s*(.+)",
    "basis": r"(?:依據|依)\s*[:：]?\s*(.+?)(?:\n|。|；)",
    "agency": r"(?:發文機關|來文單位|機關|法院|執行處)\s*[:：]\s*([^\n\r，。；]+)",
    "case_id": r"((?:北|中|南|高|桃|新)?院[^\s，。:：]*?(?:司執|家執|智|字|年度)[^\s，。]*)",
    "address": r"(?:地址)\s*[:：]\s*([^\n\r，。；]+)",
    "officer": r"(?:承辦人)\s*[:：]\s*([^\n\r，。；]+)",
    "phone": r"(?:電話|聯絡方式)\s*[:：]\s*([^\n\r，。；]+)",
    "fax": r"(?:傳真)\s*[:：]\s*([^\n\r，。；]+)",
}
FIRST_CLAUSE = r"(?s)(?:說明|理由)\s*[:：]\s*(?:一、|1[\.、])?\s*(.+?)(?:\n|。)"
LAW = r"((?:民事訴訟法|強制執行法|保險法|行政執行法|個資法|金融消費者保護法)(?:第?\s*\d+\s*條)?)"
DENSE_PARTS = [("subject", "[SUBJECT]"), ("desc", "[DESC]"), ("basis", "[BASIS]"), ("agency", "[AGENCY]"), ("case_id", "[CASE]")]
FIELD_ALIASES = {
    "recipient": ["受文者", "受文機關", "受文單位"],
    "doc_no": ["發文字號", "文號", "案號", "來文字號"],
    "date": ["發文日期", "日期", "中華民國"],
    "priority": ["速別"],
    "security": ["密等"],
    "subject": ["主旨"],
    "body": ["說明", "內文", "正文", "本文"],
    "attachment": ["附件"],
    "cc": ["副本", "正本", "抄送"],
    "contact": ["承辦", "承辦人", "聯絡", "聯絡電話", "連絡電話"],
}
TAIL_FIELDS = ("attachment", "cc", "contact")
FIRST_ENUMERATOR = r"(?m)^[（(]?(?:一|二|三|四|五|六|七|八|九|十)[)）]?[、.．]"
PERSON_FIELDS = ["姓名", "身分證字號", "財產基準日"]
ANSWER_FIELDS = ["基準日", "來函機關", "收文編號", "查詢對象"]

# --- fixed values: actions, urgency, roles ------------------------------------
ACTIONS = {
    "查詢": ["查詢", "提供資料", "提供保單資料", "資料提供", "查覆", "查復", "函覆", "復文", "函復"],
    "註記": ["註記", "維持註記", "延長註記", "警示", "限制"],
    "收取": ["收取", "代收", "逕收", "就地收取", "先行收取", "先予收取"],
    "撤銷": ["撤銷", "撤回", "撤銷前令", "撤銷命令"],
    "扣押": ["扣押", "支付轉給命令", "禁止給付", "凍結", "強制執行", "執行命令"],
    "通知": ["通知", "轉知", "知會", "請查照", "如說明辦理"],
}
URGENT = ["急件", "急速", "速", "儘速", "即刻", "從速", "逕行", "限期", "逾期", "刻不容緩", "立即"]
ROLE_LINE = r"(要保人|被保險人|受益人|債務人|債權人|公職人員)\s*[:：]\s*([^\n\r]+)"
MASKED_NAME = r"^[一-鿿][○O＊\*]{1,3}$"
SURNAMES = "陳林黃張李王吳劉蔡楊許鄭謝郭洪邱曾賴周葉蘇呂高潘朱簡鍾彭游江唐戴馮方宋施姚石杜侯阮薛盧梁趙顏余紀連馬董程溫藍蔣田魏涂米金邵湯祁白夏錢邢尤"
NOT_NAMES = ["名下", "名下所有", "清償", "所有", "本息", "利息", "保單", "帳戶", "扣押", "限制", "相關", "等", "之", "部分", "資料", "請", "應", "逕", "就地", "先予", "收取", "撤銷", "查詢", "人員", "先生", "小姐"]
NAME_SPLIT = r"[，、；;。\s\(\)（）]+"
PARENTHESES = r"[\(（][^)\n\r（）]*[\)）]"
LABEL_TERMS = [
    "保單查詢", "查詢[及和並後]*註記", "註記[及和並後]*查詢", "保單註記", "維持註記", "延長註記", "警示", "限制註記?",
    "公職人員", "政風", "廉政", "財產申報", "扣押", "支付轉給命令", "禁止給付", "強制執行法", "執行命令", "執行處",
    "撤銷(?:令|命令)?", "撤回", "撤銷前令", "(?:收取|代收|逕收).*(?:撤銷)|(?:撤銷).*(?:收取|代收|逕收)",
    "收取令", "收取", "代收", "逕收", "先行收取", "先予收取", "通知函", "轉知", "知會", "請查照", "如說明辦理",
]
NUDGES = {
    "扣押命令": (["扣押", "支付轉給命令", "禁止給付", "強制執行法", "執行處"], 0.5),
    "撤銷令": (["撤銷", "撤銷前令", "撤銷本案命令"], 0.4),
    "收取＋撤銷": (["收取並撤銷", "撤銷並收取", "先予收取並撤銷"], 0.5),
    "收取令": (["請收取", "逕收", "代收", "先行收取"], 0.3),
    "公職查詢": (["公職人員", "廉政", "政風", "財產申報"], 0.5),
    "保單註記": (["註記", "警示", "限制", "維持註記", "延長註記"], 0.4),
    "保單查詢＋註記": (["查詢並註記", "查詢及註記", "查詢後註記"], 0.4),
    "通知函": (["請查照", "如說明辦理", "轉知", "知會"], 0.2),
}

# --- fixed values: personal data ----------------------------------------------
ANY_EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
GMAIL = r"(?i)[A-Za-z0-9._%+-]+@gmail\.com"
TW_ID = r"[A-Za-z][12]\d{8}"
MOBILE = r"(?:\+886)?09\d{8}|(?:\+886)9\d{8}"
MOBILE_PLAIN = r"09\d{8}"
BIRTH_DATE = (
    r"(?:民國\d{2,3}年\d{1,2}月\d{1,2}日)|(?:\d{2,3}[/-]\d{1,2}[/-]\d{1,2})|(?:\d{2,3}\.\d{1,2}\.\d{1,2})"
    r"|(?:\d{4}[/-]\d{1,2}[/-]\d{1,2})|(?:\d{4}\.\d{1,2}\.\d{1,2})|(?:\d{4}年\d{1,2}月\d{1,2}日)"
)
SPOKEN_ROC_DATE = r"民國\d{2,3}年\d{1,2}月\d{1,2}|\d{2,3}年\d{1,2}月\d{1,2}|(?:^|[^0-9])(\d{6})(?:$|[^0-9])"
ADDRESS = (
    r"(?:臺|台)?[A-Za-z一-鿿]{1,6}(?:市|縣)[A-Za-z一-鿿]{1,6}(?:區|鄉|鎮|市)"
    r"[A-Za-z0-9一-鿿]{1,20}(?:路|街|大道|巷)[A-Za-z0-9一-鿿\-之]{0,10}"
    r"(?:段[A-Za-z0-9一-鿿]{0,5})?\d{1,4}號(?:\d{1,3}樓)?"
)
NAME_AFTER = r"(?:我是|我叫|姓名是|名字是|請問您是)([一-鿿]{2,4})"
NAME_BEFORE = r"([一-鿿]{2,4})(?:先生|小姐|女士|太太)"
LINE_ID = r"(?:^|(?<=[^\p{L}\p{N}_]))[A-Z][12]\d{8}(?=$|[^\p{L}\p{N}_])"
LINE_BIRTHDAY = r"(?:民國\s*)?\d{2,4}\s*[年/\-]\s*\d{1,2}\s*[月/\-]\s*\d{1,2}\s*[日]?"
LINE_PHONE = r"0[2-9]\d[\s\-]?\d{3,4}[\s\-]?\d{3,4}"
MASKABLE_ID = r"^[A-Z][0-9]{9}$"
MASKABLE_POLICY = r"^[A-Za-z0-9]{8,20}$"
POLICY = r"(?:保單(?:號|編號)?)[：:\s]*([A-Za-z0-9\-]{6,20})"
ID_LETTERS = "ABCDEFGHJKLMNPQRSTUVXYWZIO"
ID_WEIGHTS = [1, 9, 8, 7, 6, 5, 4, 3, 2, 1, 1]
ENTITY_KINDS = {"PERSON": "name", "GPE": "address", "LOC": "address", "FAC": "address"}
PROFILE_FIELDS = ["name", "birth_date", "id_number", "address", "mobile", "email"]

# --- fixed values: dates and times --------------------------------------------
DATE_SLASH = r"(\d{4})[/-](\d{1,2})[/-](\d{1,2})"
DATE_YEARS = r"(?:中華民國)?\s*(\d{3,4})年(\d{1,2})月(\d{1,2})日"
WITHIN_DAYS = r"(?:於|在)\s*(\d{1,3})\s*日內"
WITHIN_NUMERAL = r"(?:於|在)\s*([零〇一二兩三四五六七八九十]{1,3})\s*日內"
NUMERALS = ("零〇一二兩三四五六七八九", "001223456789")
MIN_SEC = r"^(?:(\d+)\s*分)?\s*(?:(\d+(?:\.\d+)?)\s*秒)?$"
MIN_SEC_BOTH = r"(\d+)\s*分\s*(\d+)\s*秒"
MODEL_FAMILY = r"^(.+?)[:\-_]\d+\.?\d*b"

# --- fixed values: words of the call report ------------------------------------
MISSING, YES, NO, NONE = "未提及", "是", "否", "無"
HUMAN_TAG, JSON_TAG = "【人類可讀摘要】", "【JSON_OUTPUT】"
