"""Values fixed by the national standards and by the detector vocabulary."""

# Detector types, in display order.
DETECTOR_TYPES = ("id_card", "phone", "bank_card", "uscc", "intranet_domain")

# GB 11643 resident id card, position weights and check codes.
ID_CARD_WEIGHTS = (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
ID_CARD_CHECK_CODES = "10X98765432"

# GB 32100 unified social credit code, alphabet and weights.
USCC_ALPHABET = "0123456789ABCDEFGHJKLMNPQRTUWXY"
USCC_WEIGHTS = (1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28)

# Name endings of internal zones.
INTRANET_SUFFIXES = (
    ".internal",
    ".intranet",
    ".corp",
    ".local",
    ".lan",
    ".localdomain",
    ".test",
    ".example",
    ".home.arpa",
)

# Confidence of a hit per recognizer.
CONFIDENCE = {
    "id_card": 0.99,
    "phone": 0.8,
    "bank_card": 0.9,
    "uscc": 0.97,
    "private_ip": 0.9,
    "intranet_host": 0.85,
}

# Replacement labels of the "label" mask style.
MASK_LABELS = {
    "id_card": "[身份证-已脱敏]",
    "phone": "[手机号-已脱敏]",
    "bank_card": "[银行卡-已脱敏]",
    "uscc": "[统一社会信用代码-已脱敏]",
    "intranet_domain": "[内网域名-已脱敏]",
}

# Display labels of the reports.
TYPE_LABELS = {
    "id_card": "身份证",
    "phone": "手机号",
    "bank_card": "银行卡",
    "uscc": "统一社会信用代码",
    "intranet_domain": "内网域名",
}

# Values never reported under the default rules.
DEFAULT_ALLOWLIST = ("00000000000000000X", "example.internal")

# Record format of the audit log.
AUDIT_SCHEMA_VERSION = 1
AUDIT_PREVIEW_LENGTH = 64

# The characters of a unified social credit code, in either case.
USCC_CLASS = "[0-9A-HJ-NP-RTUWXYa-hj-np-rtuwxy]"
