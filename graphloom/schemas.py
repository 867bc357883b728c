"""DDL of the tables that operators exchange."""

DOCUMENTS = "doc_ord BIGINT, content_hash STRING, source STRING, url STRING, title STRING, published STRING, fetched_at STRING, raw_text STRING, metadata MAP<STRING,STRING>, read_count BIGINT, read_fresh BOOLEAN, last_read STRING"
ARCHIVE = DOCUMENTS + ", archived_at STRING, archived_reason STRING"
MENTIONS = "content_hash STRING, doc_ord BIGINT, mention_ord INT, text STRING, label STRING, start_char INT, end_char INT"
NODES = "id BIGINT, node_key STRING, canonical_name STRING, type STRING, first_seen DATE, last_seen DATE, mention_count BIGINT, document_count BIGINT, attributes MAP<STRING,STRING>"
ALIASES = "alias STRING, node_id BIGINT"
EDGES = "id BIGINT, src_id BIGINT, dst_id BIGINT, relation STRING, weight BIGINT, strength DOUBLE, confidence DOUBLE, evidence STRING, source STRING"
NODE_DOCUMENTS = "node_id BIGINT, content_hash STRING"
RUN_HISTORY = "finished_at TIMESTAMP, scrape_seconds DOUBLE, rebuild_seconds DOUBLE, fetched BIGINT, added BIGINT, filtered BIGINT, documents BIGINT, entities BIGINT, nodes BIGINT, edges BIGINT, typed_relations BIGINT, feeds MAP<STRING,STRUCT<fetched:BIGINT,added:BIGINT,extracted:BIGINT,filtered:BIGINT,error:STRING>>, kpis MAP<STRING,DOUBLE>"
GAZETTEER = "surface STRING, canonical STRING, type STRING"
SUBFIELDS = "subfield STRING, concept STRING"
CORRECTIONS = "kind STRING, surface STRING, canonical STRING"

#: The relation name of undirected co-occurrence edges.
CO_OCCURS = "co_occurs_with"
