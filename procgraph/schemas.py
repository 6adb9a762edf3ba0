"""Table schemas of the data model."""

from __future__ import annotations

NODE_TYPES = ("event", "condition", "constraint", "equipment", "parameter")  # D1
EDGE_TYPES = ("causal", "triggers", "has_condition", "related")  # D2

NODES = "name string, node_type string, properties map<string,string>, source_tg array<string>"  # D3
EDGES = (  # D4; ord keeps the order of insertion
    "src string, dst string, edge_type string, relation_name string, confidence double, "
    "properties map<string,string>, source_tg string, ord bigint"
)
CHUNKS = (  # D6
    "id string, text string, source_file string, chunk_index int, tg_id string, file_path string, "
    "knowledge_type string, entities array<string>"
)
VECTORS = "id string, v array<float>"  # D7, D8
MOUNTS = "name string, chunk_id string, score double, rank int"  # D9
CHUNK_KEYWORDS = "chunk_id string, keyword string, weight double, pos int"  # D10, D11
RESULTS = (  # D12
    "query_id string, id string, text string, score double, source_type string, "
    "metadata map<string,string>, rank int"
)
PATHS = "query_id string, anchor_id string, anchor_score double, path array<string>, path_score double"  # D13
REASONING = (  # D14
    "query_id string, results array<struct<id:string,score:double,source_type:string>>, "
    "iterations int, explored int, tokens bigint, answer string, strategy string"
)
MERMAID_NODES = "id string, text string, node_type string, ord int"  # D15
MERMAID_EDGES = "source_id string, target_id string, label string, edge_style string, ord int"
SEQUENCE_MESSAGES = "sender string, receiver string, message string, message_type string, ord int"
FILE_LOG = (  # D16
    "file_path string, file_size bigint, modified_time double, file_hash string, processed_time timestamp, "
    "tg_id string, nodes_count int, edges_count int, success boolean, error_message string, phase string"
)
QUESTION_LOG = (  # D17
    "question_hash string, question string, answer string, retrieved_content array<string>, merged_context string, "
    "token_usage int, retrieval_time timestamp, status string, error string"
)
QA_PAIRS = (  # D18
    "id string, question string, answer string, question_type string, difficulty string, source_doc string, "
    "need_text_knowledge boolean, related_nodes array<string>, evidence string"
)
USAGE = "category string, run_id string, tokens bigint, used_at timestamp"  # D19
OUTCOME = "item string, success boolean, error_message string"  # D20
