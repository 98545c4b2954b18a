"""Explicit schemas of every table the engine reads or writes."""

DOCUMENTS = (
    "id string, source string, source_type string, native_key string, file string, title string, author string, url string, "
    "published timestamp, text string, content_hash string, words int, quote boolean"
)
CHUNKS = "id string, doc_id string, source string, index int, start int, end int, text string, hash string"
VECTORS = "chunk_id string, embed_key string, embedding array<float>"
LINKS = "url string, title string, comment string, published timestamp, file string"
#: What a parser yields for one file, before normalisation: documents, an error, or neither.
PARSED = (
    "file string, documents array<struct<native_key:string,title:string,author:string,url:string,published:timestamp,text:string>>, "
    "error string, records bigint, empty_records bigint"
)
#: One record of a posts export.
POSTS = (
    "array<struct<timestamp:bigint,title:string,data:array<struct<post:string>>,attachments:array<struct<data:array<struct<"
    "media:struct<description:string>,external_context:struct<url:string,name:string,source:string>>>>>>>"
)
