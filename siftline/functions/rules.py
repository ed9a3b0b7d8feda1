"""Rule signals: one-time-password detection and the bulk relabelling rules."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from siftline.functions.urls import FLAGS
from siftline.schema import REKLAM, SPAM

# A code of 4 to 8 digits together with one of these phrases.
OTP_CODE = r"(?U)\b\d{4,8}\b"
OTP_PHRASES = (
    r"dogrulama\s*kodu",
    r"doğrulama\s*kodu",
    r"onay\s*kodu",
    r"giriş\s*şifre",
    r"giris\s*sifre",
    r"tek\s*kullan[iı]ml[iı]k\s*şifre",
    r"tek\s*kullanimlik\s*sifre",
    r"güvenlik\s*kodu",
    r"guvenlik\s*kodu",
    r"verification\s*code",
    r"\botp\b",
    r"access\s*code",
    r"security\s*code",
    r"kimseyle\s*paylaş",
    r"kimseyle\s*paylas",
    r"başkas[iı]yla\s*paylaş",
    r"baskasiyla\s*paylas",
)
OTP_KEYWORD = FLAGS + "(?:" + "|".join(OTP_PHRASES) + ")"

# Term lists of the bulk rule for the spam bucket.
GAMBLING = FLAGS + (
    r"\b(?:bahis|casino|iddaa|jojobet|betist|betkid\w*|intbet\w*|restbet\w*|safirbet\w*"
    r"|tipobet\w*|mybahis\w*|superbahis|1xbet)\b"
)
ADULT = FLAGS + (
    r"\b(?:cinsel|penis|geciktirici\w*|azdirici\w*|viagra|ereksiyon\w*|buyutucu\w*|cialis)\b"
)
MIME_GARBLE = r"(?i)=[0-9A-F]{2}=[0-9A-F]{2}"
SKIP = "skip"


def _col(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def has_otp_code(text: Column | str) -> Column:
    return _col(text).rlike(OTP_CODE)


def has_otp_phrase(text: Column | str) -> Column:
    return _col(text).rlike(OTP_KEYWORD)


def detect_otp(text: Column | str) -> Column:
    """True when a standalone 4-8 digit code and an OTP phrase both occur."""
    return has_otp_code(text) & has_otp_phrase(text)


def is_mime_garble(text: Column | str) -> Column:
    return _col(text).rlike(MIME_GARBLE)


def has_gambling_term(text: Column | str) -> Column:
    return _col(text).rlike(GAMBLING)


def has_adult_term(text: Column | str) -> Column:
    return _col(text).rlike(ADULT)


def bulk_rule_label(text: Column | str) -> Column:
    """Garbled text is skipped, gambling and adult offers are spam, the rest is advertising."""
    return (
        F.when(is_mime_garble(text), SKIP)
        .when(has_gambling_term(text) | has_adult_term(text), SPAM)
        .otherwise(REKLAM)
    )
