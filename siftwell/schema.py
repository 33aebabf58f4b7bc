"""Schemas of the tables that operators pass on."""

from pyspark.sql import types as T

#: values of a source's format
FORMATS = ("pdf", "docx", "pptx", "xlsx", "html", "md", "txt", "image", "unknown")

PAGE = T.StructType([T.StructField("number", T.IntegerType(), False), T.StructField("markdown", T.StringType(), False), T.StructField("ocr_applied", T.BooleanType(), False)])

PAGE_SPAN = T.StructType([T.StructField("page_number", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ocr_applied", T.BooleanType())])

DOCUMENT = "doc_id string, markdown string, page_spans array<struct<page_number:int,start:int,end:int,ocr_applied:boolean>>, page_count int, ocr_pages int, source_uri string, metadata map<string,string>"

CHUNK = "id string, doc_id string, text string, index int, char_start int, char_end int, page_start int, page_end int, metadata map<string,string>"

SPAN = "array<struct<start:int,end:int>>"

QUERY = "qid long, text string"

RANKING = "qid long, chunk_id string, score double, rank int, retriever_name string, sources map<string,int>"

SPARSE = "struct<indices:array<int>,values:array<double>>"

TRACE = "trial_id string, stage string, duration_ms double, cache_hit boolean, usage map<string,double>"

TRIAL = "trial_id string, pipeline_spec string, fingerprints map<string,string>, metrics map<string,double>, cost map<string,double>, cache_hits map<string,boolean>, started_at string, finished_at string, metadata map<string,string>"
