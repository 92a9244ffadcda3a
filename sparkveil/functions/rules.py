"""Detection rules as data: patterns, thresholds, policies and names that tie them together."""

from __future__ import annotations

# Identifier types, their patterns in order of priority, and whether case is ignored.
PATTERNS: list[tuple[str, str, bool]] = [
    ("social_security_numbers", r"\b\d{3}-\d{2}-\d{4}\b|\b\d{9}\b", False),
    ("phone_numbers", r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", False),
    ("email_addresses", r"[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+", False),
    ("urls", r"https?://[\w\-._~:/?#\[\]@!$&'()*+,;=%]+|www\.[\w\-._~:/?#\[\]@!$&'()*+,;=%]+", False),
    ("ip_addresses", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", False),
    ("dates", r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{1,2}\s?[A-Za-z]{3,9}\s?\d{2,4})\b", False),
    ("medical_record_numbers", r"\b(?:MRN|mrn|Medical\s?Record\s?No\.?|Acct)[:#\s]*([0-9A-Za-z\-]{6,12})\b", False),
    ("health_plan_numbers", r"\b[A-Z0-9]{5,15}\b", False),
    ("account_numbers", r"\b(?:Acct|Account)[:#\s]*([0-9A-Za-z\-]{4,16})\b", False),
    ("certificate_license_numbers", r"\b(?:Lic|License|LT|RN|MD)[:#\s]*[A-Z0-9\-]{3,16}\b", True),
    ("vehicle_identifiers", r"\b[A-Z0-9\-]{5,8}\b", False),
    ("device_identifiers", r"\b[Ss]n[:#\s]*[0-9A-Za-z\-]{4,20}\b|\bSerial\s?No[:#\s]*[0-9A-Za-z\-]{4,20}\b", False),
    ("biometric_identifiers", r"\b(fingerprint|retina|iris|voice)\b", True),
    ("full_face_photos", r"\b(photo|photograph|full[- ]face)\b", True),
    ("geographic_locations", r"\b\d{5}(?:-\d{4})?\b|\b(?:[A-Z][a-z]+\s){0,2}(Street|St|Avenue|Ave|Boulevard|Blvd|Road|Rd)\b", False),
    ("fax_numbers", r"fax[:#\s]*\+?\d{7,15}", True),
    ("other_unique_identifiers", r"\bUID[:#\s]*[A-Z0-9\-]{4,20}\b", True),
]

# The eighteen identifier types that coverage is reported for.
TYPES = [
    "names", "geographic_locations", "dates", "phone_numbers", "fax_numbers", "email_addresses", "social_security_numbers", "medical_record_numbers", "health_plan_numbers",
    "account_numbers", "certificate_license_numbers", "vehicle_identifiers", "device_identifiers", "urls", "ip_addresses", "biometric_identifiers", "full_face_photos", "other_unique_identifiers",
]

# Thresholds of a type's confidence, and that of all others.
THRESHOLDS = {"social_security_numbers": 0.99, "medical_record_numbers": 0.98}
THRESHOLD = 0.20

# Policies by entity: tier, operator, parameters.
POLICIES: list[tuple[str, str, str, dict[str, str]]] = [
    ("AADHAAR_NUMBER", "critical", "mask", {"masking_char": "X", "chars_to_mask": "8", "from_end": "true"}),
    ("PAN_NUMBER", "critical", "mask", {"masking_char": "X", "chars_to_mask": "5", "from_end": "true"}),
    ("GSTIN", "critical", "mask", {"masking_char": "X", "chars_to_mask": "6", "from_end": "true"}),
    ("MRN_MEDICAL_RECORD_NUMBER", "critical", "replace", {"new_value": "[REDACTED_MRN]"}),
    ("CREDIT_CARD", "high_priority", "mask", {"masking_char": "*", "chars_to_mask": "12", "from_end": "true"}),
    ("BANK_ACCOUNT", "high_priority", "mask", {"masking_char": "*", "chars_to_mask": "6", "from_end": "true"}),
    ("PHONE_NUMBER", "high_priority", "mask", {"masking_char": "*", "chars_to_mask": "6", "from_end": "true"}),
    ("EMAIL_ADDRESS", "high_priority", "replace", {"new_value": "[REDACTED_EMAIL]"}),
    ("NAME", "contextual", "replace", {"new_value": "[REDACTED_NAME]"}),
    ("DATE_OF_BIRTH", "contextual", "replace", {"new_value": "[REDACTED_DOB]"}),
    ("ADDRESS", "contextual", "replace", {"new_value": "[REDACTED_ADDRESS]"}),
    ("IP_ADDRESS", "contextual", "mask", {"masking_char": "0", "chars_to_mask": "6", "from_end": "true"}),
    ("URL", "contextual", "replace", {"new_value": "[REDACTED_URL]"}),
    ("BIOMETRIC", "emerging", "replace", {"new_value": "[REDACTED_BIOMETRIC]"}),
    ("FULL_FACE_PHOTO", "emerging", "replace", {"new_value": "[REDACTED_FACE]"}),
    ("DEVICE_ID", "emerging", "mask", {"masking_char": "X", "chars_to_mask": "8", "from_end": "false"}),
    ("VOTER_ID", "high_priority", "mask", {"masking_char": "X", "chars_to_mask": "6", "from_end": "true"}),
    ("PASSPORT_NUMBER", "high_priority", "mask", {"masking_char": "X", "chars_to_mask": "6", "from_end": "true"}),
    ("SOCIAL_SECURITY_NUMBER", "critical", "mask", {"masking_char": "X", "chars_to_mask": "5", "from_end": "true"}),
    ("LICENSE_NUMBER", "contextual", "replace", {"new_value": "[REDACTED_LICENSE]"}),
    ("OTHER_UNIQUE_IDENTIFIER", "contextual", "replace", {"new_value": "[REDACTED_ID]"}),
]

#: Which policy entity an identifier type takes; the bare upper-case name is looked up in mode `as_written`.
ALIASES = {
    "social_security_numbers": "SOCIAL_SECURITY_NUMBER", "phone_numbers": "PHONE_NUMBER", "fax_numbers": "PHONE_NUMBER", "email_addresses": "EMAIL_ADDRESS", "urls": "URL", "ip_addresses": "IP_ADDRESS",
    "medical_record_numbers": "MRN_MEDICAL_RECORD_NUMBER", "account_numbers": "BANK_ACCOUNT", "certificate_license_numbers": "LICENSE_NUMBER", "device_identifiers": "DEVICE_ID", "biometric_identifiers": "BIOMETRIC",
    "full_face_photos": "FULL_FACE_PHOTO", "geographic_locations": "ADDRESS", "names": "NAME", "other_unique_identifiers": "OTHER_UNIQUE_IDENTIFIER",
}

# Further pattern sets, by name: patterns that ignore case are marked.
PATTERN_SETS: dict[str, list[tuple[str, str, bool]]] = {
    "builtin": [
        ("builtin_0", r"\b\d{3}-\d{2}-\d{4}\b", True),
        ("builtin_1", r"\b\+?\d{1,3}[ -]?\(?\d{2,3}\)?[ -]?\d{3}[ -]?\d{4}\b", True),
        ("builtin_2", r"[A-Z][a-z]+\s+[A-Z][a-z]+", True),
    ],
    "minimal": [("name", r"[A-Z][a-z]+ [A-Z][a-z]+", False), ("mrn", r"MRN[-\s]?\d{6,}", False), ("ssn", r"\d{3}[-\s]?\d{2}[-\s]?\d{4}", False), ("phone", r"\d{3}[-\s]?\d{3}[-\s]?\d{4}", False)],
    "fallback": [("name", r"[A-Z][a-z]+ [A-Z][a-z]+", False), ("mrn", r"MRN[-\s]?\d{4,}", False), ("ssn", r"\d{3}[-\s]?\d{2}[-\s]?\d{4}", False), ("phone", r"\d{3}[-\s]?\d{3}[-\s]?\d{4}", False)],
    "verification": [
        ("SSN", r"\b\d{3}-\d{2}-\d{4}\b", False),
        ("PHONE", r"\(\d{3}\)\s*\d{3}[- ]?\d{4}|\b\d{3}-\d{3}-\d{4}\b", False),
        ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", False),
        ("NAME_SIMPLE", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+(?:\s*[A-Z]\.)?\b", False),
    ],
}

# Labels of a recogniser and the identifier types they stand for.
LABELS = {"person": "names", "per": "names", "date": "dates", "gpe": "geographic_locations", "loc": "geographic_locations", "email": "email_addresses"}

# Abbreviations that are written out, and words by which a text counts as clinical.
ABBREVIATIONS = {"BP": "blood pressure", "HR": "heart rate", "DOB": "date of birth"}
CLINICAL = ["blood", "pressure", "heart", "rate", "dose", "mg", "ml", "dob", "bp", "hr"]

# Keys whose values no record may show, and the ranks of roles.
HIDDEN_KEYS = ["text", "raw", "image", "phi", "ocr_text", "page_image"]
ROLES = {"user": 1, "service_account": 2, "admin": 3}

# Confidences of the detectors of single types.
DETECTOR_CONFIDENCE = {"phone_numbers": 0.92, "geographic_locations": 0.8, "email_addresses": 0.98, "urls": 0.92, "device_identifiers": 0.85, "names": 0.6}
