"""SBI naming and identity rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Resource path prefix -> service name, first match wins.
SERVICE_PREFIXES = [
    ("/nudm-ueau/", "Nudm_UEAuthentication"),
    ("/nudm-uecm/", "Nudm_UECM"),
    ("/nudm-sdm/", "Nudm_SDM"),
    ("/nnssf-nsselection/", "Nnssf_NSSelection"),
    ("/nsmf-pdusession/", "Nsmf_PDUSession"),
    ("/nnrf-nfm/", "Nnrf_NFM"),
    ("/nnrf-disc/", "Nnrf_NFDiscovery"),
    ("/nausf-auth/", "Nausf_UEAuthentication"),
]
IMSI_IN_PATH = r"imsi-(\d{14,15})"
SUCI_IN_PATH = r"suci-(\d+)-(\d{3})-(\d{2,3})-(\d+)-(\d+)-(\d+)-([0-9a-fA-F]+)"
IMSI = r"^\d{14,15}$"


def service_name(path: Column) -> Column:
    """The service a path belongs to; other paths are named after their first
    segment, `unknown` when it is empty (B1)."""
    segment = F.split(F.ltrim(path, F.lit("/")), "/", 2)[0]
    parts = F.transform(F.split(segment, "[-_]"), lambda p: F.concat(
        F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p)))))
    named = F.when(segment == "", "unknown").otherwise(F.array_join(parts, ""))
    for prefix, service in reversed(SERVICE_PREFIXES):
        named = F.when(path.startswith(prefix), service).otherwise(named)
    return named


def supi_from_path(path: Column) -> Column:
    """The plaintext identity a path names, if any (B2)."""
    def suci(group: int) -> Column:
        return F.regexp_extract(path, SUCI_IN_PATH, group)

    # Few paths name an identity; the others need no expression.
    imsi = F.when(path.contains("imsi-"), F.regexp_extract(path, IMSI_IN_PATH, 1))
    plain = path.contains("suci-") & (suci(1) == "0") & (suci(5) == "0")
    return F.when(imsi != "", imsi).when(plain, F.concat(suci(2), suci(3), suci(7)))


def first_part(body: Column) -> Column:
    """The JSON text of a body: itself, or the first part of a multipart body."""
    trimmed = F.regexp_replace(body, r"^\s+", "")
    boundary = F.substring_index(trimmed, "\r\n", 1)
    fence = F.concat(F.lit("\r\n"), boundary)
    size = F.length(boundary)
    end = F.call_function("locate", fence, trimmed, size + 1)
    part = F.substring(trimmed, size + 1, end - size - 1)
    blank = F.instr(part, "\r\n\r\n")
    content = F.when(blank > 0, F.substring(part, blank + 4, F.length(part)))
    multipart = F.when(end > 0, content)
    return F.when(trimmed.startswith("--"), multipart).otherwise(body)


def supi_from_body(body: Column) -> Column:
    """The identity a body's `supi` field declares, if it is a full IMSI."""
    declared = F.try_variant_get(F.try_parse_json(first_part(body)), "$.supi", "string")
    kind = F.schema_of_variant(
        F.try_variant_get(F.try_parse_json(first_part(body)), "$.supi", "variant"))
    bare = F.regexp_replace(declared, "^imsi-", "")
    return F.when((kind == "STRING") & bare.rlike(IMSI), bare)


def agreed_identity(path_supi: Column, body_supi: Column) -> Column:
    """The one identity both sources agree on, else null."""
    declared = F.array_distinct(F.array_compact(F.array(path_supi, body_supi)))
    return F.when(F.size(declared) == 1, declared[0])


def problem_field(body: Column, field: str) -> Column:
    """A truthy ProblemDetails field as text."""
    found = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "variant")
    text = F.try_variant_get(F.try_parse_json(body), f"$.{field}", "string")
    kind = F.schema_of_variant(found)
    spelled = (F.when(kind == "BOOLEAN", F.when(text == "true", "True"))
               .when(kind.isin("VOID"), None)
               .when((kind != "STRING") & (text.cast("double") == 0), None)
               .otherwise(text))
    return F.nullif(spelled, F.lit(""))
