"""Fixed values of the personal-data screen: names, categories and patterns."""

from __future__ import annotations

# Column names that are personal data as they stand.
EXACT_NAMES = {
    "email": ("contact", "Contact — email"),
    "ssn": ("identity", "Identity — SSN"),
    "dob": ("identity", "Identity — date of birth"),
    "date_of_birth": ("identity", "Identity — date of birth"),
    "phone": ("contact", "Contact — phone"),
    "phone_number": ("contact", "Contact — phone"),
    "first_name": ("identity", "Identity — name"),
    "last_name": ("identity", "Identity — name"),
    "full_name": ("identity", "Identity — name"),
    "passport": ("identity", "Identity — passport"),
    "national_id": ("identity", "Identity — national ID"),
    "ip_address": ("contact", "Contact — IP address"),
    "credit_card": ("financial", "Financial — credit card"),
    "iban": ("financial", "Financial — IBAN"),
    "sort_code": ("financial", "Financial — sort code"),
    "bank_account": ("financial", "Financial — bank account"),
    "tax_id": ("financial", "Financial — tax ID"),
    "medical_record": ("health", "Health — medical record"),
    "diagnosis": ("health", "Health — diagnosis"),
    "biometric": ("health", "Health — biometric"),
    "device_id": ("behavioral", "Behavioral — device ID"),
    "mac_address": ("behavioral", "Behavioral — MAC address"),
}

# Parts of column names that hint at personal data; the first one found counts.
NAME_PARTS = {
    "name": ("identity", "Identity — name (partial)"),
    "contact": ("contact", "Contact (partial)"),
    "address": ("contact", "Contact — address"),
    "birth": ("identity", "Identity — birth date"),
    "card": ("financial", "Financial — card"),
    "account": ("financial", "Financial — account"),
    "identity": ("identity", "Identity"),
    "mobile": ("contact", "Contact — mobile"),
    "location": ("contact", "Contact — location"),
    "geo": ("contact", "Contact — geolocation"),
    "coords": ("contact", "Contact — coordinates"),
}

# Patterns of whole values; of equal hit ratios the earlier pattern counts.
# name: (pattern, ignore case, category, type)
VALUE_PATTERNS = {
    "email": (r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}$", False, "contact", "Contact — email"),
    "phone_e164": (r"^\+?[1-9]\d{7,14}$", False, "contact", "Contact — phone"),
    "phone_us": (r"^(\+1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}$", False, "contact", "Contact — phone"),
    "phone_uk": (r"^(\+44|0)7\d{9}$", False, "contact", "Contact — phone"),
    "ssn_us": (r"^\d{3}-\d{2}-\d{4}$", False, "identity", "Identity — SSN"),
    "ni_uk": (r"^[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]$", True, "identity", "Identity — NI number"),
    "postcode_uk": (r"^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$", True, "contact", "Contact — postcode"),
    "zip_us": (r"^\d{5}(-\d{4})?$", False, "contact", "Contact — ZIP code"),
    "ipv4": (r"^(\d{1,3}\.){3}\d{1,3}$", False, "contact", "Contact — IP address"),
    "ipv6": (r"^([0-9a-fA-F]{0,4}:){2,7}[0-9a-fA-F]{0,4}$", False, "contact", "Contact — IP address"),
    "credit_card": (r"^\d{13,19}$", False, "financial", "Financial — credit card"),
    "iban": (r"^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$", False, "financial", "Financial — IBAN"),
}
