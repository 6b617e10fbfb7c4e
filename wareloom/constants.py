"""Names, word lists, labels and patterns that results must agree with."""

# Canonical product fields filled from a ledger, in reporting order.
IMPORT_FIELDS = (
    "wholesale_product_id", "original_name", "price_wholesale", "price_wholesale_raw", "price_retail",
    "price_min_selling", "origin", "option_values_raw", "option_variants", "standard_options",
    "images_list", "image_detail", "wholesale_status", "wholesale_registered_at",
)
# Nested fields: a change is recorded without its old and new content.
NESTED_FIELDS = ("option_variants", "standard_options", "images_list")
# A change in one of these makes a product go through enrichment again.
REPROCESS_FIELDS = ("original_name", "images_list", "image_detail")
# A change in one of these marks the price of a listing as changed.
PRICE_FIELDS = ("price_wholesale", "price_wholesale_raw", "option_variants", "standard_options")

REQUIRED_FIELDS = (
    "wholesale_status", "wholesale_product_id", "product_code", "original_name",
    "price_wholesale_raw", "origin", "image_list_1", "image_detail",
)
OPTIONAL_FIELDS = (
    "option_values_raw", "option_price_deltas_raw", "option_skus_raw", "option_image_urls_raw",
    "price_retail", "price_min_selling", "image_list_2", "image_list_3", "image_list_4",
    "image_list_5", "wholesale_registered_at",
)
TARGET_FIELDS = REQUIRED_FIELDS + OPTIONAL_FIELDS
# Older mapping keys still understood, per current field.
LEGACY_KEYS = {
    "price_wholesale_raw": "price_wholesale",
    "option_values_raw": "options",
    "image_list_1": "images_list",
}
IMAGE_SLOTS = ("image_list_1", "image_list_2", "image_list_3", "image_list_4", "image_list_5")

# Headers recognised without any mapping, in order of preference.
HEADER_FALLBACKS = {
    "wholesale_status": ["상태", "품절상태", "품절여부", "판매상태"],
    "wholesale_product_id": ["제품번호", "제품ID", "상품ID"],
    "product_code": ["상품코드", "도매코드", "자체상품코드", "코드"],
    "original_name": ["상품명", "원본상품명", "제품명"],
    "option_values_raw": ["옵션값", "옵션", "선택사항", "옵션명"],
    "option_image_urls_raw": ["옵션이미지", "옵션 이미지", "옵션별이미지", "옵션별 이미지"],
    "price_wholesale_raw": ["가격", "공급가", "도매가", "공급가격", "도매가격"],
    "price_retail": ["소비자가", "소매가", "소매가격"],
    "price_min_selling": ["판매준수가", "최소판매가", "최저가"],
    "origin": ["원산지", "제조국", "제조국가"],
    "image_list_1": ["목록이미지1", "대표이미지", "이미지", "상품이미지"],
    "image_list_2": ["목록이미지2"],
    "image_list_3": ["목록이미지3"],
    "image_list_4": ["목록이미지4"],
    "image_list_5": ["목록이미지5"],
    "image_detail": ["상세이미지", "상세설명이미지"],
    "wholesale_registered_at": ["등록일", "상품등록일"],
}

# Bounds on user-supplied mapping rules (None: any size); what exceeds one is refused with a warning, never shortened.
RULE_LIMITS = {"value_map_entries": None, "regex": None}

# Supplier status spellings and their canonical form.
STATUS_SPELLINGS = {
    "정상": "판매중", "판매중": "판매중", "품절": "품절", "일시품절": "품절",
    "판매중지": "판매중지", "중지": "판매중지", "단종": "단종",
}
UNAVAILABLE_STATUSES = ("품절", "판매중지", "단종")
DISCONTINUED_STATUS = "단종"
CRAWL_STATUSES = ("available", "sold_out", "stopped", "unknown")
# Crawl status as written into an exported ledger; a missing status counts as on sale.
EXPORT_STATUS = {"sold_out": "품절", "stopped": "판매중지", "available": "판매중"}

INT_MAX = 2147483647
OPTION_GROUP_NAME = "옵션"

FIELD_LABELS = {
    "wholesale_status": "품절상태", "price_wholesale": "도매가", "price_wholesale_raw": "도매가(원본)",
    "price_retail": "소비자가", "price_min_selling": "최소판매가", "origin": "원산지",
    "option_values_raw": "옵션", "option_variants": "옵션 구성", "standard_options": "표준 옵션",
    "images_list": "목록 이미지", "image_detail": "상세 이미지", "original_name": "상품명",
    "wholesale_product_id": "도매상품번호", "wholesale_registered_at": "등록일",
}
CHANGE_LABELS = {
    "sold_out": "품절", "restocked": "재입고", "price_changed": "가격 변경",
    "stock_changed": "재고 변경", "status_changed": "상태 변경",
}

# Shop platforms and the markers that give them away, checked in this order.
PLATFORM_MARKERS = (
    ("cafe24", ("xans-", "/product/detail.html", "ec-base-")),
    ("makeshop", ("mk_menu", "shopdetail.html", "shopbrand.html")),
    ("godomall", ("/goods/goods_view.php", "godomall", "godo.co.kr")),
    ("youngcart", ("/shop/item.php", "g5_", "sit_title")),
    ("wisa", ("wisa", "/shop/goods/goods_view.php")),
)

KEYWORD_STOP_WORDS = ("랜덤", "박스채", "배송비", "무료배송", "추천", "강추", "최고", "인기")
TRADEMARKS = ("나이키", "아디다스", "삼성", "LG", "애플", "소니", "다이슨", "샤오미")
QUANTITY_PATTERN = r"[0-9]+(개|세트|p|입)"

NAME_MAX_TOKENS = 9
NAME_MAX_LENGTH = 50
NAME_MAX_REPEATS = 2

# Query parameters that usually carry a product code, strongest first.
CODE_PARAMETERS = (
    "branduid", "goodsno", "goods_no", "product_no", "productno", "prdno", "prd_no", "pid", "itemid",
    "item_id", "it_id", "pcode", "p_code", "code", "uid", "idx", "no", "id",
)
# Path or query fragments of pages that are not products.
NON_PRODUCT_FRAGMENTS = (
    "member", "login", "join", "cart", "basket", "order", "deposit", "charge", "point", "mileage", "board",
    "notice", "event", "company", "guide", "mypage", "wish", "faq", "qna", "search", "shopbrand",
    "goods_list", "list.php", "category", "brand.html",
)
NON_PRODUCT_NAMES = "적립금|예치금|충전|쿠폰|상품권|배송비|샘플구매|묶음배송"
UNNAMED = "(이름 없음)"

JUNK_IMAGE_PATTERN = r"(?i)blank|spacer|1x1|no_?image|noimg|transparent|/icon"
SKIP_IMAGE_PATTERN = r"(?i)(^|[/_\-])(icon|btn|quick)([/_\-.]|$)|banner_sm"
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".webp")
LAZY_IMAGE_ATTRIBUTES = ("src", "data-src", "data-original", "data-lazy", "data-echo")
DETAIL_IMAGE_MIN_PX = 300
QUANTITY_SELECT_MARKERS = ("qty", "quantity", "수량")

KEY_FIELDS = ("raw_product_name", "supply_price", "main_image_url", "supplier_product_code")
WARNING_FIELDS = ("supplier_status", "origin", "detail_content", "extra_image_urls")
DISTINCT_FIELDS = ("raw_product_name", "supplier_product_code", "main_image_url")
ORIGIN_NOISE = r"판매가|공급가|배송비|상품코드|상품명|대표\s*이미지|옵션"
BUY_WORDS = ("cart", "buy", "구매", "장바구니", "purchase")

# Ledger headers written on export, in order.
EXPORT_HEADERS = (
    "상태", "제품번호", "상품코드", "상품명", "가격", "원산지", "목록이미지1", "상세이미지", "옵션값",
    "옵션이미지", "목록이미지2", "목록이미지3", "목록이미지4", "목록이미지5", "등록일",
)
PROCESSED_EXPORT_HEADERS = (
    "상품고유ID", "원래상품명", "정제상품명", "키워드", "네이버카테고리", "쿠팡카테고리", "가공상태", "등록일",
)

MUTABLE_DRAFT_STATUSES = ("generated", "needs_review", "ready", "failed")
SUBMITTING = "submitting"
ACTIVE_DRAFT_STATUSES = MUTABLE_DRAFT_STATUSES + (SUBMITTING,)
SUBMITTABLE_DRAFT_STATUSES = ("ready", "needs_review", "generated")
POLICY_MARKER_KEYS = ("shippingCost", "marketplaceFee", "targetMargin", "rounding")
SUPPORTED_MARKETS = ("smartstore", "coupang")
# A platform name still stored for the market it became.
MARKET_ALIASES = {"naver": "smartstore"}

# Leading labels per field, and price labels in order of preference.
LABEL_PATTERNS = {
    "raw_product_name": r"(?s)^\s*(?:상품명|제품명|상품이름)\s*[:：]\s*(.+)$",
    "supplier_product_code": r"(?s)^\s*(?:상품코드|제품코드|상품번호|코드)\s*[:：]\s*(.+)$",
    "brand_name": r"(?si)^\s*(?:브랜드|brand)\s*[:：]\s*(.+)$",
    "manufacturer": r"(?si)^\s*(?:제조사|제조원|manufacturer)\s*[:：]\s*(.+)$",
    "model_name": r"(?si)^\s*(?:모델명|모델|model)\s*[:：]\s*(.+)$",
}
ORIGIN_LABEL = r"(?:원산지|제조국가|제조국)\s*[:：]\s*([^\n/|,]+)"
ORIGIN_ANY_LABEL = r"^\s*[^\n:：]{1,20}[:：]\s*([^\n/|,]+?)\s*$"
PRICE_LABELS = ("공급가", "도매가", "판매가격", "판매가", "소비자가", "정가", "시중가")
PRICE_LABEL_COUNT = "소비자가|판매가격|판매가(?!격)|공급가|도매가|정가|시중가"

# Credential-shaped values; groups 2 and 3 hold the opening quote.
SECRET_PATTERNS = (
    r"""(?i)(authorization\b["']?\s*[:=]\s*)(?:(")(?:\\.|[^"\\])*"|(')(?:\\.|[^'\\])*'|bearer\s+[^\s,;}]+|[^\s,;}]+)""",
    r"(?i)(\bbearer\s+)[^\s,;]+",
    r"""(?i)(\b(?:api[_ -]?key|access[_ -]?token|token|password|passwd|secret)\b["']?\s*[:=]\s*)(?:(")(?:\\.|[^"\\])*"|(')(?:\\.|[^'\\])*'|[^\s,;}]+)""",
)

# Sold-out wording, with "not sold out" excepted.
CART_BUTTON_PATTERN = "장바구니|구매|주문|Buy|Cart"
SOLD_OUT_HINT = r"(?i)품절|매진|완판|sold\s*out|재고\s*없"  # without the exception of the pattern below
SOLD_OUT_PATTERN = r"(?i)품절(?!\s*아님)|매진|완판|sold\s*out|재고\s*없"
# Price marks at the end of an option text: bracketed, or plain.
OPTION_PRICE_BRACKETED = r"\s*[\(\[]\s*([+-])\s*([0-9,]+)\s*원?\s*[\)\]]\s*$"
OPTION_PRICE_TRAILING = r"\s*(?:[/|:]\s*)?([+-])\s*([0-9,]+)\s*원?\s*$"

# Every whitespace character that trimming removes.
WHITESPACE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
              "\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Back-quotes and control characters that sanitising blanks out.
UNPRINTABLE = r"[`\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
# Every credential pattern needs one of these words.
SECRET_WORDS = ("authorization", "bearer", "api", "token", "password", "passwd", "secret")
