"""Fixed schemas of the evidence model. Missing labels are states in a string column; null means that nothing was produced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DDL = {
    "document": "doc_id string, batch_id string, file_sha256 string, meta struct<title:string,abstract:string,authors:array<string>,journal:string,doi:string,keywords:array<string>>, metadata_sources map<string,string>, year_print int, year_online int, year_doi int, year_conflict boolean",
    "section": "doc_id string, section_id string, parent_id string, depth int, ord int, title string, zone string, zone_source string",
    "zone_slice": "doc_id string, zone string, text string, n_words int, zone_sha256 string",
    "glyph_warning": "doc_id string, page int, font string, codepoint string, n bigint",
    "evidence_block": "evidence_id string, doc_id string, section_id string, section_title string, page int, zone string, text string, retrieval_text string, char_start int, char_end int, kind string, text_sha256 string, retrieval_sha256 string, source_sha256 string, formula_layout_risk boolean, n_words int",
    "dense_vector": "evidence_id string, model string, dim int, v array<float>",
    "posting": "term string, evidence_id string, tf int",
    "term_stats": "term string, df bigint",
    "doc_len": "evidence_id string, len int",
    "retrieval_query": "query_id string, dimension string, text string, relevant_ids array<string>",
    "retrieval_manifest": "run_id string, query_id string, channel string, evidence_id string, score double, rank int, params map<string,string>",
    "context_window": "window_id string, doc_id string, dimension string, budget int, n_tokens int, evidence_ids array<string>, text string, sha256 string",
    "dimension_record": "doc_id string, dimension string, label string, secondary_labels array<string>, mechanism string, uncertainty string, evidence array<struct<evidence_id:string,section_id:string,page:int,char_start:int,char_end:int,verbatim_quote:string>>, schema_version string, pass int",
    "critic_record": "doc_id string, dimension string, decision string, corrected_label string, critic_comment string, supporting_evidence_ids array<string>, contradicting_evidence_ids array<string>, confidence double, checks map<string,string>, pass int",
    "verified_record": "doc_id string, dimension string, label string, secondary_labels array<string>, mechanism string, uncertainty string, evidence array<struct<evidence_id:string,section_id:string,page:int,char_start:int,char_end:int,verbatim_quote:string>>, schema_version string, decision string, adjudication_required boolean",
    "model_call": "agent_name string, provider string, model_name string, model_version string, endpoint string, prompt_version string, input_hash string, output_hash string, temperature double, seed bigint, input_tokens bigint, output_tokens bigint, retries int, call_ts timestamp, failure_reason string",
    "synthesis_claim": "claim_id string, kind string, chapter int, statement string, supporting array<string>, contradicting array<string>, boundary string",
    "frdi_result": "direction string, scheme string, year_basis string, esi double, tgm double, lci double, frdi double, rank int",
    "gold_label": "item_id string, dimension string, annotator string, annotator_kind string, label string",
    "run_manifest": "run_id string, stage string, inputs array<struct<path:string,sha256:string>>, config_sha256 string, code_sha256 string, versions map<string,string>, created timestamp",
    "schema_registry": "schema_version string, dimension string, label string, active boolean, note string",
    "trace_edge": "src_id string, src_kind string, dst_id string, dst_kind string, relation string",
}

SCHEMAS: dict[str, T.StructType] = {}


def schema(name: str) -> T.StructType:
    if name not in SCHEMAS:
        SCHEMAS[name] = T._parse_datatype_string(_DDL[name])
    return SCHEMAS[name]


NAMES = tuple(_DDL)


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` in the columns and types of an entity; columns it lacks are null, others are refused."""
    want = schema(name)
    unknown = set(df.columns) - set(want.names)
    if unknown:
        raise ValueError(f"{name} has no column {sorted(unknown)}")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
