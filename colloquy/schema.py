"""Schemas of the base tables."""

from __future__ import annotations

TURNS = (
    "issue_id string, speech_id string, speech_order int, date string, meeting string, speaker string, speaker_group string, "
    "speaker_position string, speaker_role string, speech string, speech_url string, ord bigint"
)
PAIRS = (
    "case_id string, ministry string, question string, answer string, speaker string, position string, speaker_title string, date string, "
    "meeting string, url string, question_url string, context string, relevance double"
)
LABELED = "question string, answer string, ministry string, speaker string, position string, date string, meeting string, url string"
REVIEWS = "id string, beneficiary string, activity string, relation string, comparison string, decision string, q string, a string"
SPEECH_JSON = (
    "struct<speechID:string,speaker:string,speakerGroup:string,speakerPosition:string,speakerRole:string,speech:string,speechURL:string,speechOrder:string>"
)
MEETINGS_JSON = f"issueID string, date string, nameOfMeeting string, speechRecord array<{SPEECH_JSON}>"
LAWS_JSON = (
    "items array<struct<law_info:struct<law_id:string,law_type:string>,revision_info:struct<law_title:string>,sentences:array<struct<text:string>>>>, next_offset bigint"
)
