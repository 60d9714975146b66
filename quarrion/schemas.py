"""Schemas of the record types."""

from __future__ import annotations

from pyspark.sql import types as T



SCHEMAS: dict[str, str] = {
    "questions": "question_id string, dataset string, split string, question string, gold_answer string, gold_passages array<string>, gold_passages_full array<string>",
    "passages": "passage_id string, title string, text string",
    "chunks": "passage_id string, source_id string, chunk_index int, chunk_count int, char_start int, char_end int, title string, text string",
    "nested_context": "_id string, question string, answer string, context array<struct<title:string,sents:array<string>>>, supporting_facts array<struct<title:string,idx:int>>",
    "paragraphs": "id string, question string, answer string, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>",
    "claims": "id bigint, claim string, label string, verifiable string, evidence array<array<array<string>>>",
    "wiki_pages": "id string, text string, lines string",
    "qa_csv": "question string, long_answers string, short_answers string",
    "clause_queries": "_id string, text string, metadata struct<category:string,split:string,type:string,parent_query_id:string>",
    "clause_corpus": "_id string, text string",
    "qrels": "`query-id` string, `corpus-id` string, score string",
    "near_miss": "a string, b string",
    "retriever_examples": "query_id string, query string, category string, doc_id string, document string, label int, label_type string, difficulty string, score int, source_query_ids array<string>",
    "trick_queries": "query_id string, near_miss_id string, trick_queries array<string>",
    "sentences": "sentence_id string, chunk_id string, sent_idx int, span_start int, span_end int, expanded boolean, context string, text string",
    "graph_nodes": "pid string, vec_id bigint, keywords array<string>, conditioned_score double, query_sim double",
    "graph_edges": "src string, dst string, oq_id string, iq_id string, oq_text string, conditioned_score double",
    "hop_trace": "question_id string, gold array<string>, hops array<struct<hop:int,expanded_from:array<string>,new_passages:array<string>,none_count:int,repeat_visit_count:int>>",
    "answers": "question_id string, dataset string, split string, variant string, retriever string, prediction string, tokens bigint, seconds double",
    "usage": "shard string, question_id string, key string, value string",
    "aliases": "dropped_id string, kept_id string",
}


def schema(name: str) -> T.StructType:
    """The schema of a record type."""
    return T.StructType.fromDDL(SCHEMAS[name])
