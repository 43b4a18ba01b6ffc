"""Schemas of the tables that the library works on."""

from __future__ import annotations

OFFSET = "struct<start:int,end:int>"
TOKEN = f"struct<string:string,offset:{OFFSET},prediction:string,gold_label:string,prob:double>"
DOCUMENT = "doc_id bigint, abstract string, fulltext string"
SEGMENT = "doc_id bigint, segment int, input_ids array<int>, attention_mask array<tinyint>"
RELATION = "doc_id bigint, subject bigint, object bigint, label int"
REFERENCE = "enzyme string, organism string, reference string, pubmed_id string, pmc string"
ANNOTATION = "annotator string, doc_id bigint, annotation string"
METRICS = "optimizer string, lr double, lr_scheduler string, dropout double, hidden_layers int, hidden_size int, normalization string, batch_size int, num_epochs int, patience int, val_loss double, val_loss_std double, strain_f1 double, strain_f1_std double"
#: The curation tables, as a database delivers them.
CURATION = {
    "fact": "fact_id int, organism_id int, ec_class_id int, strain_id int, reference_id int, protein_id int",
    "reference": "reference_id int, authors string, title string, journal string, volume string, pages string, year int, pubmed_id string, path string",
    "organism": "organism_id int, organism string",
    "ec_class": "ec_class_id int, ec_class string, recommended_name string",
    "protein": "protein_id int, protein string",
}
