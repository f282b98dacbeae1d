"""Constants, word lists, patterns and formats of the data model.

Results depend on these values, so they are kept as plain text in one place.
Patterns that differ on purpose from the studied rules carry the question number
parentheses are literal (Q6), term ends are exact (Q7), registration numbers end
where digits end (Q8), amounts may be ungrouped (Q9), Korean companies match both
written forms (extension of Q6).
"""

# ---- fixed values: languages -------------------------------------------------
LANGUAGES = ["jpn", "eng", "kor", "chi_sim", "chi_tra"]
LANGUAGE_ALIASES = {
    "ja": "jpn",
    "en": "eng",
    "ko": "kor",
    "zh": "chi_sim",
    "zh-cn": "chi_sim",
    "zh-hans": "chi_sim",
    "zh-tw": "chi_tra",
    "zh-hant": "chi_tra",
    "ja-jp": "jpn",
    "en-us": "eng",
    "ko-kr": "kor",
    "jpn": "jpn",
    "eng": "eng",
    "kor": "kor",
    "chi_sim": "chi_sim",
    "chi_tra": "chi_tra",
}
# case-sensitive codes a block detector reports
BLOCK_LANGUAGE_CODES = {
    "ja": "jpn",
    "en": "eng",
    "ko": "kor",
    "zh-Hans": "chi_sim",
    "zh-CN": "chi_sim",
    "zh-Hant": "chi_tra",
    "zh-TW": "chi_tra",
}
DEFAULT_LANGUAGE = "jpn"

# ---- fixed values: recognisers -----------------------------------------------
ENGINE_WEIGHTS = {
    "custom_model": 0.5,
    "tesseract": 0.2,
    "google_vision": 0.2,
    "azure_form": 0.1,
}
CONFIDENCE_THRESHOLD = 0.85
SCALE_FACTORS = [1.0, 1.5, 2.0]
RECOGNISER_BATCH = 8

# ---- fixed values: files ------------------------------------------------------
MIME_TYPES = {
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".tiff": "image/tiff",
    ".tif": "image/tiff",
    ".bmp": "image/bmp",
    ".gif": "image/gif",
    ".pdf": "application/pdf",
}
MAX_FILE_BYTES = 20 * 1024 * 1024
MAX_NAME_CHARS = 128
SIZE_UNITS = ["B", "KB", "MB", "GB", "TB"]

# ---- fixed values: page plan ---------------------------------------------------
MAX_PAGES = 100
MAX_SIDE_PX = 4000
MIN_SIDE_PX = 600
PAGE_BATCH = 8
CACHE_TTL_SECONDS = 3600
PAGE_SIZE = 20

# ---- fixed values: validation patterns -----------------------------------------
VALID_EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
VALID_URL = r"^(https?|ftp)://[^\s/$.?#].[^\s]*\z"
LANGUAGE_OPTIONS = [
    "jpn", "eng", "kor", "chi_sim", "chi_tra",
    "ja", "en", "ko", "zh",
    "ja-jp", "en-us", "ko-kr", "zh-cn", "zh-tw",
    "zh-hans", "zh-hant",
]
FIELD_TYPES = [
    "text", "date", "amount", "company", "person", "address", "phone", "email", "number",
]

# ---- fixed values: text clean-up ------------------------------------------------
FULLWIDTH_DIGITS = "０１２３４５６７８９"
ASCII_DIGITS = "0123456789"
MIDDLE_DOTS = "﹅﹆"
#: Letters whose usual capital is two letters, and their capital of one.
SINGLE_CAPITALS = (
    "ßᾀᾁᾂᾃᾄᾅᾆᾇᾐᾑᾒᾓᾔᾕᾖᾗᾠᾡᾢᾣᾤᾥᾦᾧᾳῃῳ",
    "ẞᾈᾉᾊᾋᾌᾍᾎᾏᾘᾙᾚᾛᾜᾝᾞᾟᾨᾩᾪᾫᾬᾭᾮᾯᾼῌῼ",
)
KOREAN_PARTICLES = "을|를|이|가|은|는|의|에|로|으로|에서|도|만"
EMAIL_CASE = r"([a-zA-Z0-9_.+-]+)@([a-zA-Z0-9-]+)\.([a-zA-Z0-9-.]+)"
ENGLISH_TERMS = {
    "Ud.": "Ltd.",
    "Ine.": "Inc.",
    "Ilc": "LLC",
    "Lld.": "Ltd.",
    "limiled": "limited",
    "corporalion": "corporation",
}
SENTENCE_BREAKS = {
    "jpn": r"(?<=[。．！？])",
    "kor": r"(?<=[.!?])",
    "eng": r"(?<=[.!?])\s",
    "chi_sim": r"(?<=[。！？])",
    "chi_tra": r"(?<=[。！？])",
}
HTML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")]
FORM_KEYWORDS = ["form", "application", "registration", "申請書", "応募", "登録", "フォーム"]
LOGO_KEYWORDS = ["logo", "brand"]

# ---- fixed values: business formats (language, kind, pattern, replacement) -------
# Digits are anchored where an unanchored rule would split a longer number.
BUSINESS_FORMATS = {
    "jpn": [
        ("date", r"(\d{4})年(\d{1})月(\d{1})日", "$1年0$2月0$3日"),
        ("date", r"(\d{4})年(\d{2})月(\d{1})日", "$1年$2月0$3日"),
        ("date", r"(\d{4})年(\d{1})月(\d{2})日", "$1年0$2月$3日"),
        ("date", r"(令和|平成|昭和)(\d{1})年(\d{1})月(\d{1})日", "$1$2年0$3月0$4日"),
        ("date", r"(令和|平成|昭和)(\d{2})年(\d{1})月(\d{1})日", "$1$2年0$3月0$4日"),
        ("prefix_amount", "¥", ""),
        ("suffix_amount", "円", ""),
        ("company", "株式含社", "株式会社"),
        ("company", "株式会杜", "株式会社"),
        ("company", "株式會社", "株式会社"),
        ("company", "有恨会社", "有限会社"),
        ("company", "含同会社", "合同会社"),
        ("postcode", r"〒\s*(\d{3})\s*[-−]\s*(\d{4})", "〒$1-$2"),
    ],
    "kor": [
        ("date", r"(\d{4})년\s*(\d{1})월\s*(\d{1})일", "$1년 0$2월 0$3일"),
        ("date", r"(\d{4})년\s*(\d{2})월\s*(\d{1})일", "$1년 $2월 0$3일"),
        ("date", r"(\d{4})년\s*(\d{1})월\s*(\d{2})일", "$1년 0$2월 $3일"),
        ("date", r"(?<!\d)(\d{4})[./-](\d{1})[./-](\d{1})(?!\d)", "$1-0$2-0$3"),
        ("date", r"(?<!\d)(\d{4})[./-](\d{2})[./-](\d{1})(?!\d)", "$1-$2-0$3"),
        ("date", r"(?<!\d)(\d{4})[./-](\d{1})[./-](\d{2})(?!\d)", "$1-0$2-$3"),
        ("prefix_amount", "₩", ""),
        ("suffix_amount", "원", ""),
        ("company", r"\(주\)\s*식\s*회\s*사", "(주)"),
        ("company", r"주\s*식\s*회\s*사", "주식회사"),
        ("registration", r"(?<!\d)(\d{3})\s*[-−]?\s*(\d{2})\s*[-−]?\s*(\d{5})(?!\d)", "$1-$2-$3"),
    ],
    "eng": [
        ("date", r"(\w{3})\s+(\d{1}),\s+(\d{4})", "$1 0$2, $3"),
        ("date", r"(?<!\d)(\d{1})/(\d{1})/(\d{4})(?!\d)", "0$1/0$2/$3"),
        ("date", r"(?<!\d)(\d{1})/(\d{2})/(\d{4})(?!\d)", "0$1/$2/$3"),
        ("date", r"(?<!\d)(\d{2})/(\d{1})/(\d{4})(?!\d)", "$1/0$2/$3"),
        ("prefix_amount", "$", ""),
        ("suffix_amount", "USD", " "),
        ("company", r"Inc\b\.?", "Inc."),
        ("company", r"Corp\b\.?", "Corp."),
        ("company", r"Ltd\b\.?", "Ltd."),
        ("company", r"LLC\b\.?", "LLC"),
        ("company", r"LLP\b\.?", "LLP"),
    ],
}

# ---- fixed values: entity patterns ------------------------------------------------
ENTITY_TYPES = ["companies", "dates", "amounts", "persons", "addresses", "emails", "phones"]
EMAIL_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE_PATTERNS = [
    r"\+\d{1,3}[\s-]?\(?\d{1,4}\)?[\s-]?\d{1,4}[\s-]?\d{1,4}",
    r"\d{2,4}[\s-]?\d{2,4}[\s-]?\d{2,4}",
]
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# Amounts take a grouped number or a plain run of digits; a badly grouped number is none.
NUMBER = r"(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?(?!\d|,\d)"
ENTITY_PATTERNS = {
    "jpn": {
        "companies": [
            r"株式会社[\s]?([^\s・（()]{1,20})",
            r"合同会社[\s]?([^\s・（()]{1,20})",
            r"有限会社[\s]?([^\s・（()]{1,20})",
        ],
        "dates": [
            r"(令和|平成|昭和)?\s*(\d{1,2})?\s*年\s*(\d{1,2})?\s*月\s*(\d{1,2})?\s*日",
            r"\d{4}年\d{1,2}月\d{1,2}日",
            r"\d{4}/\d{1,2}/\d{1,2}",
        ],
        "amounts": [r"¥\s*" + NUMBER, NUMBER + r"\s*円"],
    },
    "kor": {
        "companies": [
            r"(?:\(주\)|주\s*식\s*회\s*사)\s*([^\s]{1,20})",
            r"([^\s]{1,20})\s*(?:\(주\)|주\s*식\s*회\s*사)",
        ],
        "dates": [
            r"\d{4}년\s*\d{1,2}월\s*\d{1,2}일",
            r"\d{4}[-\.]\d{1,2}[-\.]\d{1,2}",
        ],
        "amounts": [r"₩\s*" + NUMBER, NUMBER + r"\s*원"],
    },
    "eng": {
        "companies": [
            r"([A-Z][a-zA-Z0-9\s,]{2,30})\s+(Inc|Corp|LLC|Ltd|LLP|Limited|Corporation)\.?",
            r"([A-Z][a-zA-Z0-9\s,]{2,30})\s+Company",
        ],
        "dates": [
            r"(" + MONTHS + r")[a-z]*\.?\s+\d{1,2},\s+\d{4}",
            r"\d{1,2}\s+(" + MONTHS + r")[a-z]*\.?\s+\d{4}",
            r"\d{1,2}/\d{1,2}/\d{4}",
            r"\d{4}-\d{1,2}-\d{1,2}",
        ],
        "amounts": [r"\$\s*" + NUMBER, r"USD\s*" + NUMBER],
    },
}
ADDRESS_PATTERNS = [r"〒\d{3}-\d{4}", r"[東西南北]?京都?[府県]"]
ADDRESS_CONTEXT = 30

# ---- fixed values: default extraction fields ----------------------------------------
DEFAULT_FIELDS = [
    {
        "name": "invoice_number",
        "type": "text",
        "context": r"청구서 번호|請求書番号|インボイス番号|No\.|番号",
        "regex": r"(\d{1,3}[\-\.]\d{1,3}[\-\.]\d{1,5})",
    },
    {
        "name": "date",
        "type": "date",
        "context": "날짜|発行日|日付|date",
        "regex": r"(\d{4}[-/年\.]{1,2}\d{1,2}[-/月\.]{1,2}\d{1,2}[日]?)",
    },
    {
        "name": "total_amount",
        "type": "amount",
        "context": "총액|合計|総額|total",
        "regex": r"([¥￥]?\s*[\d,\.]+\s*[円]?)",
    },
    {
        "name": "company_name",
        "type": "company",
        "context": "회사명|会社名|企業名|company",
        "regex": "",
    },
    {
        "name": "tax_amount",
        "type": "amount",
        "context": "세금|税額|消費税|tax",
        "regex": r"([¥￥]?\s*[\d,\.]+\s*[円]?)",
    },
]

# ---- fixed values: wording of an extraction request ----------------------------------
REQUEST_INSTRUCTIONS = {
    "jpn": "일본어 문서에서 다음 필드를 추출하세요.",
    "eng": "Extract the following fields from this English document.",
    "kor": "한국어 문서에서 다음 필드를 추출하세요.",
    "chi_sim": "从这份简体中文文档中提取以下字段。",
    "chi_tra": "從這份繁體中文文檔中提取以下字段。",
}
REQUEST_CONTEXT = "\n   키워드: {} 주변에서 값을 찾으세요."
REQUEST_PATTERN = '\n   패턴: 일반적인 형식은 "{}"와 같습니다.'
REQUEST_HINTS = {
    "date": "\n   날짜 형식을 YYYY-MM-DD로 정규화하세요. 예: 2024-02-15",
    "amount": "\n   금액에서 통화 기호와 쉼표를 제거하고 숫자만 반환하세요. 예: 1000.50",
    "company": "\n   회사명에서 법적 형태(주식회사, LLC 등)를 포함하여 전체 이름을 추출하세요.",
}
REQUEST_TITLE = "# 문서 필드 추출\n\n"
REQUEST_FIELDS = "\n\n## 추출할 필드\n"
REQUEST_RULES = """

## 추출 규칙
1. 존재하지 않거나 확인할 수 없는 필드는 null로 반환하세요.
2. 값이 있으면 정확히 추출하되, 필요 시 정규화하세요.
3. 주변 문맥을 고려하여 가장 관련성 높은 값을 선택하세요.
4. 여러 비슷한 값이 있으면, 문서 문맥에 가장 적합한 것을 선택하세요.
5. 응답은 JSON 형식으로 제공하세요.

## OCR로 추출된 텍스트
```
"""
REQUEST_ANSWER = """
```

## 응답 형식
다음과 같은, 필드 이름과 해당 값으로 이루어진 JSON 형식으로 응답하세요:
```json
{
  "필드1": "값1",
  "필드2": "값2",
  ...
}
```
JSON만 반환하고 다른 설명은 포함하지 마세요."""

# ---- fixed values: layout thresholds --------------------------------------------------
STAMP_MIN_AREA, STAMP_ASPECT, STAMP_CONFIDENCE = 500, (0.5, 2.0), 0.8
HANDWRITING_MIN_AREA, HANDWRITING_RATIO, HANDWRITING_MEAN, HANDWRITING_CONFIDENCE = 200, 0.5, 3.0, 0.7
TABLE_MIN_AREA, TABLE_ASPECT, TABLE_DENSITY, TABLE_CONFIDENCE = 5000, (0.5, 5.0), 0.05, 0.9
STRIKE_LENGTH, STRIKE_DENSITY, STRIKE_CONFIDENCE = 50, 0.1, 0.6
STRIKE_FLAT_DEGREES = (20, 160)
FINE_STAMP_RADIUS = (30, 150)
FINE_STAMP_CIRCULARITY = 0.7
FINE_SQUARE_CONFIDENCE = 0.85
FINE_STROKE_WIDTH = 1.5
FINE_STROKE_VARIANCE = 0.5
FINE_STRIKE_THICKNESS = (2, 10)
FINE_WRITING_AREA, FINE_WRITING_ASPECT, FINE_WRITING_MAX_BOX = 500, (0.2, 5.0), 50000
DOCUMENT_TYPES = ["receipt", "invoice", "form", "handwritten"]

# ---- fixed values: image parameters by language and document type -----------------------
IMAGE_PARAMETERS = [
    "binarization_method", "threshold", "block_size", "c_value", "blur_kernel",
    "denoise_h", "edge_enhancement", "contrast", "sharpness",
]
LANGUAGE_PARAMETERS = {
    "jpn": ("adaptive", 180, 15, 9, 3, 10, 1.5, 1.3, 1.4),
    "kor": ("adaptive", 180, 13, 8, 3, 10, 1.4, 1.2, 1.3),
    "eng": ("adaptive", 190, 11, 7, 3, 8, 1.3, 1.2, 1.2),
    "chi_sim": ("adaptive", 175, 15, 9, 3, 10, 1.4, 1.3, 1.4),
    "chi_tra": ("adaptive", 175, 15, 9, 3, 10, 1.4, 1.3, 1.4),
}
DOCUMENT_PARAMETERS = {
    "receipt": ("adaptive", 200, 15, 5, 3, 12, 1.6, 1.4, 1.5),
    "invoice": ("adaptive", 190, 15, 7, 3, 10, 1.4, 1.3, 1.3),
    "form": ("adaptive", 180, 19, 11, 5, 15, 1.3, 1.1, 1.2),
    "handwritten": ("adaptive", 170, 21, 13, 5, 15, 1.2, 1.5, 1.6),
}

# ---- fixed values: metrics and alerts -----------------------------------------------------
METER_TICK_SECONDS = 5
METER_WINDOWS = {"1m": 60.0, "5m": 300.0, "15m": 900.0}
COOLDOWN_SECONDS = 300
SEVERITIES = ["info", "warning", "error", "critical"]
COMPARATORS = [">", ">=", "<", "<=", "==", "!="]
RATE_LIMITS = {"admin": 1000, "user": 100, "anonymous": 10}
DEFAULT_RATE_LIMIT = 10
THRESHOLD_MESSAGE = "%s: %s의 값 %s이(가) 임계값 %s을(를) %s 만족합니다."
CHANGE_MESSAGE = "%s: %s의 변화량이 %.2f%s로, 임계값 %s%s을(를) 초과했습니다."
FLUSH_SECONDS = 10
FLUSH_POINTS = 1000
