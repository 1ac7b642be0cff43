"""Rules, vocabularies and word lists that must be equal to those users have today. Kept as plain text."""

from __future__ import annotations

#: Detection rules by language, in order: type, expression, flags.
EN_RULES = (
    ("ID", r"\b\d{3}-\d{2}-\d{4}\b", "IGNORECASE"),
    ("PHONE", r"\b(?:\+1[-.\s]?|1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", ""),
    ("EMAIL", r"[\w\.\-]+@[\w\.\-]+\.[A-Za-z]{2,}", ""),
    ("ADDRESS", r"\b\d+\s+\w+\s+(?:Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd|Lane|Ln)\b", ""),
    ("PASSPORT", r"[A-PR-WYa-pr-wy][1-9]\d\s?\d{4}[1-9]", ""),
    ("UNIFIED_BUSINESS_NO", r"\b\d{2}-\d{7}\b", ""),
    ("MEDICAL_ID", r"\b[A-Za-z0-9]{6,12}\b", ""),
)
ZH_RULES = (
    ("ID", r"[A-Z]\d{9}", "IGNORECASE"),
    ("PHONE", r"09\d{2}-?\d{3}-?\d{3}", "MULTILINE"),
    ("EMAIL", r"[\w\.-]+@[\w\.-]+\.[A-Za-z]{2,4}", ""),
    ("ADDRESS", r"(台北市|台中市|高雄市)[^,，°]{3,20}(路|街|巷)\d+號?", ""),
    ("ADDRESS", r"(臺北市|台北市|新北市|桃園市|臺中市|台中市|臺南市|台南市|高雄市)[^,，°]{1,30}(路|街|巷|大道|段)\d+號", ""),
    ("ADDRESS", r"[^\n，；。]{1,30}(村|里)([^\n，；。]{1,20})(鄰)\d+號", ""),
    ("ADDRESS", r"(\d+樓|\d+樓之\d|\d+樓之\d+)", ""),
    ("ADDRESS", r"(建國路|中山北路|信義路|光復南路|民生東路)[^,，°]{1,20}段?\d+號", ""),
    ("ADDRESS", r"\d{3,4}巷\d{1,3}弄\d{1,3}號", ""),
    ("ADDRESS", r"[^\n，；。]{1,30}(大樓|社區|大廈|商業大樓)[^,，；。]{0,30}", ""),
    ("PASSPORT", r"[A-Z]{1,2}\d{6,8}", ""),
    ("UNIFIED_BUSINESS_NO", r"\d{8}", ""),
    ("MEDICAL_ID", r"[A-Z]\d{7,8}", ""),
)
STUB_RULES = (("ID", r"[A-Z][12]\d{8}", ""), ("PHONE", r"09\d{2}-?\d{3}-?\d{3}", ""))
RULES = {"en": EN_RULES, "zh": ZH_RULES, "stub": STUB_RULES}
#: The priority of types in conflicts; other types have 50.
PRIORITY = {"ID": 100, "PASSPORT": 95, "PHONE": 90, "UNIFIED_BUSINESS_NO": 85, "EMAIL": 80, "NAME": 75, "ADDRESS": 70, "ORGANIZATION": 65, "MEDICAL_ID": 60}
#: Expressions that check a type in evaluations.
TYPE_PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE": r"(?:\+?\d{1,3}[-\s]?)?(?:0?9\d{8}|\d{2,4}[-\s]?\d{3,4}[-\s]?\d{3,4})",
    "ID": r"[A-Z][12]\d{8}",
    "UNIFIED_BUSINESS_NO": r"\b\d{8}\b",
    "BANK_ACCOUNT": r"\b\d{10,20}\b",
    "CREDIT_CARD": r"\b(?:\d[ -]*?){13,19}\b",
    "LICENSE_PLATE": r"\b[A-Z]{2,3}-?\d{3,4}\b",
    "PASSPORT": r"\b[A-Z]{1,2}\d{7,8}\b",
    "MEDICAL_ID": r"\bM\d{7}\b",
    "URL": r"https?://[^\s]+",
    "IP_ADDRESS": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "DATE": r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b",
}
#: Expressions of the leak check, of placeholders, and of markup.
LEAK_PATTERNS = {"ID": r"[A-Z]\d{9}", "PHONE": r"09\d{2}-?\d{3}-?\d{3}", "EMAIL": r"[\w\.-]+@[\w\.-]+\.[A-Za-z]{2,}"}
PLACEHOLDER = r"([<\[{])([A-Za-z_]+?)(?:_?\d+)?([>\]}])"
XML_MARKUP = r"<PII\s+type=['\"]([A-Za-z0-9_]+)['\"]\s*>(.*?)</PII>"
BRACKET_MARKUP = r"\[([A-Za-z0-9_]+)\](.*?)\[/\1\]"
#: Names of the canonical types, by type.
TYPE_NAMES = {
    "NAME": "PER PERSON NAME FULLNAME FULL_NAME FIRSTNAME FIRST_NAME GIVENNAME GIVEN_NAME LASTNAME LAST_NAME SURNAME MIDDLE_NAME PATIENT_NAME DOCTOR_NAME",
    "USERNAME": "USERNAME USER_NAME HANDLE",
    "EMAIL": "EMAIL EMAIL_ADDRESS",
    "PHONE": "PHONE PHONE_NUMBER MOBILE TEL FAX",
    "ID": "ID SSN NATIONAL_ID DRIVER_LICENSE",
    "PASSPORT": "PASSPORT",
    "MEDICAL_ID": "MEDICAL_ID",
    "UNIFIED_BUSINESS_NO": "UNIFIED_BUSINESS_NO",
    "ADDRESS": "ADDRESS LOCATION LOC GPE CITY STATE ZIP POSTAL_CODE",
    "ORGANIZATION": "ORG ORGANIZATION COMPANY HOSPITAL",
    "DATE": "DATE DOB DATE_OF_BIRTH BIRTHDATE",
    "TIME": "TIME DATETIME",
    "IP_ADDRESS": "IP IP_ADDRESS",
    "URL": "URL WEBSITE",
    "CREDIT_CARD": "CREDIT_CARD CREDITCARD",
    "BANK_ACCOUNT": "BANK_ACCOUNT ACCOUNT_NUMBER IBAN",
    "LICENSE_PLATE": "LICENSE_PLATE PLATE",
    "AGE": "AGE",
}
EXACT_TYPES = {name: kind for kind, names in TYPE_NAMES.items() for name in names.split()}
#: For other names, expressions looked for in this order.
TYPE_HINTS = (
    ("EMAIL", "MAIL"),
    ("PHONE", "PHONE|^TEL|MOBILE"),
    ("PASSPORT", "PASSPORT"),
    ("MEDICAL_ID", "MED.*ID|ID.*MED"),
    ("ID", "ID$|SSN"),
    ("NAME", "NAME"),
    ("USERNAME", "USER|HANDLE"),
    ("ADDRESS", "ADDRESS|CITY|STATE|ZIP|POSTAL"),
    ("ORGANIZATION", "ORG|COMPANY|HOSPITAL"),
    ("DATE", "DATE|BIRTH|^DOB$"),
    ("TIME", "TIME"),
    ("IP_ADDRESS", "IP"),
    ("URL", "URL|WEB"),
    ("CREDIT_CARD", "CREDIT|CARD"),
    ("BANK_ACCOUNT", "BANK|ACCOUNT|IBAN"),
    ("LICENSE_PLATE", "PLATE|LICENSE"),
    ("AGE", "AGE"),
)
#: Label maps of token datasets and models, and of masked pairs.
BIO_TYPES = {"PER": "NAME", "PERSON": "NAME", "LOC": "ADDRESS", "GPE": "ADDRESS", "ORG": "ORGANIZATION"}
MODEL_TYPES = BIO_TYPES | {"ID": "ID", "PHONE": "PHONE", "EMAIL": "EMAIL", "ADDRESS": "ADDRESS", "ORGANIZATION": "ORGANIZATION"}
WIKI_LABELS = ("B-LOC", "B-ORG", "B-PER", "I-LOC", "I-ORG", "I-PER", "O")
PAIR_TYPES = BIO_TYPES | {
    "NAME": "NAME", "EMAIL": "EMAIL", "EMAIL_ADDRESS": "EMAIL", "PHONE": "PHONE", "PHONE_NUMBER": "PHONE", "MOBILE": "PHONE", "TEL": "PHONE", "ADDRESS": "ADDRESS", "LOCATION": "ADDRESS",
    "ORGANIZATION": "ORGANIZATION", "ID": "ID", "SSN": "ID", "PASSPORT": "PASSPORT", "MEDICAL_ID": "MEDICAL_ID", "UNIFIED_BUSINESS_NO": "UNIFIED_BUSINESS_NO",
}
#: What an output must not contain, in lower case; phrases users ban by default; prefixes of outputs.
NEEDLES = ("input:", "output:", "analysis:", "explanation:", "step", "reason:")
MARKUP_LEFT, MARKUP_TRIGGER = ("<pii", "[/"), "<PII>/<[/...]>"
BANNED = ("任務：", "規則：", "解釋", "原因", "步驟", "分析", "以下是", "下面是", "我會", "你可以", "Explanation", "Steps", "Reason")
PREFIXES = ("輸出：", "Output:", "OUTPUT:")
#: Punctuation that noise swaps for its other form.
SWAPS = {"，": ",", "。": ".", "：": ":", "；": ";"}
#: Words of synthetic records.
NAMES = {"en": ("John Smith", "Alice Chen", "Michael Brown", "Emily Davis"), "zh": ("王小明", "陳怡君", "林志明", "張雅婷")}
ADDRESSES = {"en": ("1 Main St", "10 Broadway Ave", "99 Market Rd"), "zh": ("台北市信義路1號", "新北市中山路10號", "台中市民生路99號")}
LABELS = {"en": ("Patient name: ", "Contact: ", "Address: ", "ID: "), "zh": ("病患姓名：", "聯絡方式：", "地址：", "身分證：")}
ID_LETTERS = "ABCDEFGHJKLMNPQRSTUVXYWZ"
CITIES = "台北市 新北市 基隆市 宜蘭縣 桃園市 新竹市 新竹縣 苗栗縣 台中市 彰化縣 南投縣 雲林縣 嘉義市 嘉義縣 台南市 高雄市 屏東縣 花蓮縣 台東縣 澎湖縣 金門縣 連江縣".split()
STREETS = "中山 中正 忠孝 仁愛 信義 和平 民族 民權 民生 復興 建國 成功 光復 新生 羅斯福 重慶 南京 杭州".split()
STREET_KINDS = "路 街 大道".split()
SURNAMES = "陳 林 黃 張 李 王 吳 劉 蔡 楊 許 鄭 謝 郭 洪 邱 曾 廖 賴 周".split()
GIVEN_NAMES = "怡君 志明 雅婷 建宏 美玲 俊傑 怡如 冠宇 雅惠 宗翰 淑芬 家豪 淑惠 志偉 雅玲 俊宏 怡婷 志豪 佳蓉 彥廷 淑娟 志強 靜怡 建志 佩珊 柏翰 慧君 承翰 欣怡 冠廷".split()
HOSPITALS = "台大醫院 台北榮總 長庚紀念醫院 馬偕醫院 國泰醫院 新光醫院 三軍總醫院 萬芳醫院 亞東醫院 慈濟醫院".split()
SPECIALTIES = "內科 外科 兒科 婦產科 骨科 神經科 心臟科 眼科 耳鼻喉科 皮膚科".split()
DOMAINS = "gmail.com yahoo.com.tw hotmail.com outlook.com msn.com pchome.com.tw hinet.net".split()
CARD_PREFIXES = ("4", "5", "34", "37", "6")
PARAGRAPHS = (
    "根據最新報告顯示，{PII} 的情況需要進一步關注。",
    "在 {DATE} 的會議中，我們討論了關於 {NAME} 的提案。",
    "請聯絡 {NAME}，電話號碼是 {PHONE}，地址是 {ADDRESS}。",
    "病患 {NAME}，病歷號碼 {MEDICAL_RECORD}，將於下週進行複診。",
    "信用卡號 {CREDIT_CARD} 將於本月到期，請更新付款資訊。",
    "您的身份證字號 {TW_ID} 需要進行驗證。",
    "寄送地址：{ADDRESS}，收件人：{NAME}。",
    "請於 {DATE} 攜帶身分證 {TW_ID} 至本機構辦理手續。",
    "電子郵件 {EMAIL} 已收到您的諮詢，將盡快回覆。",
    "護照號碼 {PASSPORT} 已通過審核，可至櫃台領取。",
)
