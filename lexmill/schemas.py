"""Explicit schemas of the corpus store; dates and times are strings ('' = none), deletion is soft."""

from __future__ import annotations

VERSION = 7

BLOCK = "struct<type:string,level:int,text:string,align:string,rows:array<array<string>>>"
HIT = "struct<start:int,end:int,wrong:string,suggestion:string,category:string,reason:string,confidence:double,kind:string,severity:string>"

TABLES = {
    "categories": "id long, parent_id long, name string, sort int, created_time string",
    "documents": f"id long, title string, content_text string, blocks array<{BLOCK}>, file_path string, file_type string, tags string, category_id long, text_hash string, word_count int, import_time string, updated_time string, simhash long, deleted_time string",
    "dictionary": "id long, word string, pinyin string, definition string, example string, source string",
    "error_pairs": "id long, wrong string, correct string, category string, confidence double, enabled int, source string",
    "user_phrases": "id long, phrase string, context string, source string, tag string",
    "wordlist_sources": "source string, role string, label string, fmt string, entry_count int, imported_at string, enabled int",
    "ignore_words": "word string, note string",
    "snapshots": "id long, doc_id long, title string, content string, reason string, created_time string",
    "dispatch_register": "id long, doc_no string, title string, doc_type string, org string, main_send string, cc string, secret_level string, urgency string, sign_date string, print_date string, pages int, copies int, drafter string, reviewer string, approver string, status string, doc_id long, remark string",
    "receive_register": "id long, reg_no string, incoming_no string, title string, doc_type string, from_org string, main_send string, cc string, secret_level string, urgency string, receive_date string, doc_date string, pages int, copies int, propose string, instruction string, handler_dept string, handler string, due_date string, done_date string, result string, status string, archive_no string, retention string, archive_date string, doc_id long, remark string",
    "attachments": "id long, doc_id long, file_name string, stored_path string, size long, added_time string",
    "fts_index_state": "kind string, ref_id long, text_hash string",
    "paragraphs": "id long, doc_id long, ordinal int, kind string, level int, text string, char_offset int, text_hash string",
}
