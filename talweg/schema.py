"""Fixed schemas and enumerations of manifests, ledgers and consents."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# Column names in file order.
MANIFEST = _strings(
    "sample_id", "relative_path", "sha256", "split", "label", "language", "code_switch", "parent_group_id", "source_name",
    "source_license", "rights_basis", "speaker_pseudo_id", "text_id", "text_hash", "duration_s", "generator_family",
    "generator_name", "generator_version", "voice_id", "clone_consent_id", "device", "capture_route", "original_sr", "codec",
    "augmentation_chain", "augmentation_seed", "created_at",
)
LEDGER = _strings(
    "source_id", "usage_scope", "train_dev_test_use", "ood_evaluation_use", "bonafide_group_provenance",
    "spoof_voice_group_provenance", "license", "source_url", "artifact_name", "expected_size_bytes", "last_modified_utc",
    "sha256", "rights_basis", "status", "notes",
)
CONSENT = _strings(
    "consent_record_id", "speaker_pseudo_id", "language", "collection_version", "product_training_authorized",
    "synthetic_derivatives_authorized", "commercial_deployment_authorized", "status", "signed_at", "revoked_at",
)
JOURNAL = T.StructType(
    [
        T.StructField("candidate_id", T.StringType()),
        T.StructField("line", T.LongType()),
        T.StructField("event", T.StringType()),
        T.StructField("output_sha256", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
SPLITS = ("train", "dev", "test", "ood")
LABELS = ("bonafide", "spoof")
LANGUAGES = ("ru", "kk", "mixed", "other")
CODE_SWITCH = ("true", "false", "unknown")
GENERATOR = ("generator_family", "generator_name", "generator_version", "voice_id")
OPTIONAL = (*GENERATOR, "clone_consent_id", "augmentation_chain", "augmentation_seed")
MANDATORY = tuple(n for n in MANIFEST.names if n not in OPTIONAL)
# Fixed values of ledgers and consents.
APPROVED_STATUSES = ("verified", "owner_authorized_personal_research")
PROTOCOL_USES = ("product_allowed", "research_only", "prohibited")
GROUP_PROVENANCES = ("verified", "source_provided", "unknown", "not_applicable")
CONSENT_LANGUAGES = ("ru", "kk", "mixed")
CONSENT_STATUSES = ("active", "revoked")
CONSENT_SCOPES = ("product_training_authorized", "synthetic_derivatives_authorized", "commercial_deployment_authorized")
LEAKAGE_FIELDS = ("parent_group_id", "speaker_pseudo_id", "text_hash")
