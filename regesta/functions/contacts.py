"""E-mail addresses and telephone numbers: reading, cleaning, classifying, validating."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from regesta.functions.keys import trimmed


# Parts of an address's local part that name an office rather than a person.
OFFICE_ROOTS = (
    "contact", "mairie", "secretariat", "secretaire", "accueil", "info", "communication", "associ", "club", "sport", "culture",
    "jeunesse", "service", "direction", "administration", "courrier", "webmaster", "bureau", "president", "tresorier", "inscription",
    "reservation", "ecole", "cantine", "commune", "ville", "hoteldeville", "noreply", "nepasrepondre", "postmaster", "abuse",
)
# What ends like an address's domain but is a file.
FILE_SUFFIXES = r"(?i)\.(?:png|jpe?g|gif|webp|svg|css|js)$"
# How addresses and numbers look in running text; white space of any kind counts, as on the web.
EMAIL_IN_TEXT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
WRITTEN_OUT_EMAIL = (
    r"(?iU)([A-Za-z0-9._%+-]+)\s*(?:\[|\()?\s*(?:at|arobase|chez)\s*(?:\]|\))?\s*([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*?)"
    r"\s*(?:\[|\()?\s*(?:dot|point)\s*(?:\]|\))?\s*([A-Za-z]{2,})"
)
PHONE_IN_TEXT = r"(?U)(?:\+33[\s.-]?|\b0)[1-9](?:[\s.-]?\d{2}){4}\b"
# National prefixes of mobile numbers.
MOBILE_PREFIXES = ("06", "07")
# The shape of an address, of a person's address, and of a number, and the parts of well-formed addresses.
EMAIL_SHAPE = r"^[^\s@]+@[^\s@]+\.[A-Za-z]{2,}$"
PERSON_SHAPE = r"^[a-z]+[.\-_][a-z]{2,}$"
PHONE_SHAPE = r"^\+33[1-9]\d{8}$"
LOCAL_PART = r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*$"
DOMAIN_LABEL = r"^[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?$"
TOP_LEVEL = r"^[A-Za-z]{2,}$"
#: How sure a way of reading is: declared by the page, seen in its text, put together from words.
DECLARED, SEEN, REBUILT = 0.9, 0.6, 0.45


def clean_email(raw: Column) -> Column:
    """An address without the brackets, quotes and stops around it; null where the shape is wrong, it names a file, or is over 254 characters."""
    v = F.regexp_replace(F.regexp_replace(trimmed(raw), r"""^[<("']+""", ""), r"""[>)"',.;]+$""", "")
    fits = v.rlike(EMAIL_SHAPE) & ~v.rlike(FILE_SUFFIXES) & (F.length(v) <= 254)
    return F.when(fits, v)


def office_or_person(address: Column) -> Column:
    """1 for the address of an office, 0 for one formed like a person's name, null where its form does not tell."""
    local = F.lower(F.substring_index(address, "@", 1))
    office = F.regexp_replace(local, "[^a-z0-9]", "").rlike("|".join(OFFICE_ROOTS))
    return F.when(office, 1).when(local.rlike(PERSON_SHAPE), 0)


def international_phone(raw: Column) -> Column:
    """+33 and nine digits, or null. Only +33, 0033 and a leading 0 are read, and nothing but digits may be between."""
    digits = F.regexp_replace(raw, r"[^0-9+]", "")
    national = (
        F.when(digits.startswith("+33"), F.concat(F.lit("0"), F.substr(digits, F.lit(4))))
        .when(digits.startswith("0033"), F.concat(F.lit("0"), F.substr(digits, F.lit(5))))
        .when(digits.startswith("0"), digits)
    )
    return F.when(national.rlike(r"^0[1-9]\d{8}$"), F.concat(F.lit("+33"), F.substr(national, F.lit(2))))


def is_mobile(phone: Column) -> Column:
    """Of an international number: does its national form begin like a mobile's?"""
    return F.concat(F.lit("0"), F.substring(phone, 4, 1)).isin(*MOBILE_PREFIXES)


def mail_domain(address: Column) -> Column:
    """What follows the last @, in lower case, if it has a dot; else null."""
    domain = F.lower(F.substring_index(address, "@", -1))
    return F.when(address.contains("@") & domain.contains("."), domain)


def email_fault(address: Column) -> Column:
    """Why an address is not well formed, by the first rule it breaks: longueur, arobase, partie_locale, domaine, domaine_de_tete; null if it is."""
    domain = F.substring_index(address, "@", -1)
    local = F.substr(address, F.lit(1), F.greatest(F.length(address) - F.length(domain) - 1, F.lit(0)))
    labels = F.split(domain, r"\.", -1)
    return (
        F.when((F.length(address) == 0) | (F.length(address) > 254), "longueur")
        .when(~address.contains("@") | (local == "") | (domain == "") | local.contains("@"), "arobase")
        .when(F.length(local) > 64, "longueur")
        .when(~local.rlike(LOCAL_PART), "partie_locale")
        .when(F.length(domain) > 253, "longueur")
        .when((F.size(labels) < 2) | F.exists(labels, lambda x: ~x.rlike(DOMAIN_LABEL)), "domaine")
        .when(~F.element_at(labels, -1).rlike(TOP_LEVEL), "domaine_de_tete")
    )


def phone_fault(number: Column) -> Column:
    return F.when(~number.rlike(PHONE_SHAPE), "forme")


def contact_fault(kind: Column, value: Column) -> Column:
    return F.when(kind == "email", email_fault(value)).otherwise(phone_fault(value))


def contacts_in_text(text: Column) -> Column:
    """Every address and number of a text: array of (kind, valeur, valeur_normalisee, is_generique, methode, confiance), in the order in which they are read."""
    emails = F.transform(F.regexp_extract_all(text, F.lit(EMAIL_IN_TEXT), F.lit(0)), lambda x: F.struct(F.lit("email").alias("kind"), x.alias("raw"), F.lit("texte:motif").alias("methode"), F.lit(SEEN).alias("confiance")))
    phones = F.transform(F.regexp_extract_all(text, F.lit(PHONE_IN_TEXT), F.lit(0)), lambda x: F.struct(F.lit("phone").alias("kind"), x.alias("raw"), F.lit("texte:motif").alias("methode"), F.lit(SEEN).alias("confiance")))
    joined = F.transform(F.regexp_extract_all(text, F.lit(WRITTEN_OUT_EMAIL), F.lit(0)), lambda x: F.regexp_replace(x, "^" + WRITTEN_OUT_EMAIL + "$", "$1@$2.$3"))
    rebuilt = F.transform(joined, lambda x: F.struct(F.lit("email").alias("kind"), x.alias("raw"), F.lit("texte:obfusque").alias("methode"), F.lit(REBUILT).alias("confiance")))
    return read_contacts(F.concat(emails, phones, rebuilt))


def read_contacts(raw: Column) -> Column:
    """Cleans an array of (kind, raw, methode, confiance); what is no address or number falls out."""
    read = F.transform(
        raw,
        lambda x: F.struct(
            x["kind"].alias("kind"),
            F.when(x["kind"] == "email", clean_email(x["raw"])).otherwise(F.trim(x["raw"])).alias("valeur"),
            F.when(x["kind"] == "email", F.lower(clean_email(x["raw"]))).otherwise(international_phone(x["raw"])).alias("valeur_normalisee"),
            F.when(x["kind"] == "email", office_or_person(clean_email(x["raw"]))).alias("is_generique"),
            x["methode"].alias("methode"),
            x["confiance"].alias("confiance"),
        ),
    )
    return F.filter(read, lambda x: x["valeur_normalisee"].isNotNull())
