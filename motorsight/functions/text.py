"""Text and time functions as column expressions.

Everything is built-in Spark SQL: regular expressions, ``translate``,
``split`` + higher-order functions and literal maps.  No Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed_values as fv


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Characters Python's str.split() treats as whitespace (ASCII and Unicode), as one class.
SPLIT_WS = "[" + "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000" + "]+"


def ascii_digits(text) -> Column:
    """Arabic-Indic and Eastern Arabic-Indic digits -> ASCII (Java's \\d is ASCII only)."""
    return F.translate(_c(text), fv.ARABIC_INDIC_DIGITS + fv.EASTERN_ARABIC_INDIC_DIGITS,
                       "0123456789" * 2)


def ocr_number(text) -> Column:
    """trim, drop spaces, comma -> dot, first ``[-+]?\\d*\\.?\\d+`` as double."""
    cleaned = F.replace(F.replace(F.trim(ascii_digits(text)), F.lit(" "), F.lit("")),
                        F.lit(","), F.lit("."))
    m = F.regexp_extract(cleaned, fv.OCR_NUMBER_PATTERN, 0)
    return F.when(m != "", m.try_cast("double"))


def _number_words_map(words: dict) -> Column:
    return F.create_map(*[x for k, v in words.items() for x in (F.lit(k), F.lit(float(v)))])


def speech_number(text, language) -> Column:
    """first run of digits, else the first known number word of the language.

    Arabic words are matched as written (a word with the prefix "و" is unknown);
    French and English are lower-cased first."""
    t = ascii_digits(text)
    lang = F.lower(_c(language))
    digits = F.regexp_extract(t, fv.SPEECH_NUMBER_PATTERN, 0)
    from_digits = F.when(digits != "", digits.try_cast("double"))

    def first_word(words: dict, lowercase: bool) -> Column:
        src = F.lower(t) if lowercase else t
        toks = F.filter(F.split(src, SPLIT_WS), lambda w: w != "")
        m = _number_words_map(words)
        known = F.filter(toks, lambda w: F.array_contains(F.map_keys(m), w))
        return F.try_element_at(m, F.try_element_at(known, F.lit(1)))

    words = (F.when(lang.startswith("ar"), first_word(fv.NUMBER_WORDS_AR, False))
             .when(lang.startswith("fr"), first_word(fv.NUMBER_WORDS_FR, True))
             .otherwise(first_word(fv.NUMBER_WORDS_EN, True)))
    return F.coalesce(from_digits, words)


def best_detection(det, group: str, value: str, confidence: str, order_id: str):
    """F24 + P12: per group, the value of the highest-confidence detection (the
    first by ``order_id`` on ties); detections without a number or with
    confidence 0 never win; 'Please verify' under 0.7."""
    ok = det.filter(F.col(value).isNotNull() & (F.col(confidence) > 0))
    g = ok.groupBy(group).agg(
        F.max_by(F.col(value), F.struct(F.col(confidence), -F.col(order_id))).alias(value),
        F.max(confidence).alias(confidence))
    return g.withColumn("warning", F.when(F.col(confidence) < fv.LOW_CONFIDENCE, F.lit("Please verify")))


def work_shift(ts) -> Column:
    """morning 6-14, afternoon 14-22, else night."""
    h = F.hour(_c(ts))
    (m0, m1), (a0, a1) = fv.SHIFT_MORNING, fv.SHIFT_AFTERNOON
    return (F.when((h >= m0) & (h < m1), F.lit("morning"))
            .when((h >= a0) & (h < a1), F.lit("afternoon"))
            .otherwise(F.lit("night")))


def working_hours_flag(ts) -> Column:
    """hour between 8 and 18 inclusive."""
    lo, hi = fv.WORKING_HOURS
    return F.hour(_c(ts)).between(lo, hi).cast("int")


def kelvin_to_celsius_text(k) -> Column:
    """K -> "%.1f" degrees C text, 'N/A' when absent."""
    return F.when(_c(k).isNull(), F.lit("N/A")).otherwise(F.format_string("%.1f", _c(k) - F.lit(273.15)))


def remaining_time_text(hours, language: str = "fr", compact: bool = False) -> Column:
    """< 24 h -> hours, else whole days (h // 24); absent or 0 -> NULL."""
    h = _c(hours).cast("long")
    if compact:
        hour_txt = F.format_string("~%dh", h)
        day_txt = F.format_string("~%d jours", F.floor(h / 24).cast("long"))
    else:
        hour_txt = F.concat(F.lit(fv.ALERT_REMAIN[language]), h.cast("string"), F.lit(fv.ALERT_HOURS[language]))
        day_txt = F.concat(F.lit(fv.ALERT_REMAIN[language]), F.floor(h / 24).cast("long").cast("string"),
                           F.lit(fv.ALERT_DAYS[language]))
    return F.when(h.isNull() | (h == 0), F.lit(None).cast("string")) \
        .when(h < 24, hour_txt).otherwise(day_txt)


def percent_text(p) -> Column:
    """``{p:.0%}``: probability as a whole percent (half-even, like Python's format)."""
    return F.concat(F.bround(_c(p) * 100, 0).cast("long").cast("string"), F.lit("%"))


def alert_message(machine_id, failure_type, p, hours, stamp, language: str) -> Column:
    """Alert text in French ('fr') or Arabic ('ar'); ``stamp`` is a timestamp column."""
    from .rules import alert_icon
    remain = remaining_time_text(hours, language)
    parts = [
        F.lit("\n"), alert_icon(p), F.lit(" " + fv.ALERT_TITLE[language] + "\n\n"),
        F.lit(fv.ALERT_MACHINE[language]), _c(machine_id).cast("string"), F.lit("\n"),
        F.lit(fv.ALERT_FAILURE[language]), _c(failure_type), F.lit("\n"),
        F.lit(fv.ALERT_PROB[language]), percent_text(p), F.lit("\n"),
        F.coalesce(F.concat(remain, F.lit("\n")), F.lit("")),
        F.lit("\n📅 "), F.date_format(_c(stamp), "yyyy-MM-dd HH:mm"),
        F.lit("\n\n" + fv.ALERT_CLOSING[language]),
    ]
    return F.concat(*parts)


def daily_summary_message(day, at_risk, critical, language: str) -> Column:
    """Daily summary text."""
    return F.concat(
        F.lit("\n" + fv.SUMMARY_TITLE[language] + "\n\n📅 "), F.date_format(_c(day), "yyyy-MM-dd"),
        F.lit("\n\n" + fv.SUMMARY_CRITICAL[language]), _c(critical).cast("string"),
        F.lit("\n" + fv.SUMMARY_AT_RISK[language]), _c(at_risk).cast("string"),
        F.lit("\n\n" + fv.SUMMARY_CLOSING[language] + "\n"))
