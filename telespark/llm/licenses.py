"""Licence scan: whole texts looked up by the digest of their canonical form."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, whole_text
from .license_texts import KNOWN

#: Known texts that one lookup may broadcast, at most.
MAX_KNOWN = 100_000

# Spellings that count as equal (the published matching
# guidelines for licence texts), each written as the second of its pair.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"),
    ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"),
    ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"),
    ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"),
    ("licence", "license"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"),
    ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"),
    ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("noncommercial", "non commercial"),
    ("copyright owner", "copyright holder"), ("per cent", "percent"), ("sub license", "sublicense"),
)

# Lines that state a copyright: they start with the word or the sign and have both,
# or a year.  (A line of a licence may start with the word alone.)  Marks outside ASCII are named one
# by one, so that letters of any script count.  Without inline flags and
# anchors, so that other engines read the patterns alike.
COPYRIGHT_LINE = r"(^|\n)[^\na-z0-9]*(copyright[^\na-z0-9]*(\(c\)|©)|\(c\)[^\na-z0-9]*copyright|©|(copyright|\(c\))[^\na-z0-9]+[0-9]{4})[^\n]*"
MARKS = r"[!-/:-@\[-`{-~\x00-\x20\x{A0}©\x{2010}-\x{2015}\x{2018}-\x{201F}•…]+"


def canonical(text: Column) -> Column:
    """The text with A-Z folded, without copyright lines, with one space for
    each run of marks and blanks, and with one spelling for equivalent words."""
    t = F.regexp_replace(ascii_lower(text), COPYRIGHT_LINE, "\n")
    t = F.concat(F.lit(" "), F.btrim(F.regexp_replace(t, MARKS, " ")), F.lit(" "))
    # Most texts hold none of the words: one search decides.
    rare = t.rlike(" (" + "|".join(a for a, _ in EQUIVALENT) + ") ")
    spelled = t
    for a, b in EQUIVALENT:
        for _ in range(2):  # neighbours share a blank: every other one is left for the second time
            spelled = F.replace(spelled, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.btrim(F.when(rare, spelled).otherwise(t))


def lookup(docs: DataFrame, known: Mapping[str, str] | DataFrame = KNOWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, canonical_sha256, license_id) for every row of docs; license_id is null for unknown texts.

    ``known``: licence texts by name, or a table (license_id, text).  Texts
    match as a whole: their canonical forms have the same SHA-256.  Of known
    texts with one form the smallest name counts.  Null and empty texts, and
    texts of marks and copyright lines only, have the empty form, which is
    no licence.  Rows are independent of each other, repeated ones too.  An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    if isinstance(known, Mapping):
        known = spark.createDataFrame(sorted(known.items()), "license_id string, text string")
    digest = F.sha2(canonical(F.col("text")).cast("binary"), 256)
    forms = known.where(canonical(whole_text()) != "").select("license_id", digest.alias("canonical_sha256"))
    forms = forms.groupBy("canonical_sha256").agg(F.min("license_id").alias("license_id"))
    if known.count() <= MAX_KNOWN:
        forms = F.broadcast(forms)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).select("doc_id", digest.alias("canonical_sha256"))
    return rows.join(forms, "canonical_sha256", "left").select("doc_id", "canonical_sha256", "license_id")
