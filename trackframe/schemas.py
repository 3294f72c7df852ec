"""Schemas of the tables that the operators take; readers never infer them."""

POINT = "struct<x:double,y:double>"
BOX = "struct<x:int,y:int,width:int,height:int>"
CLIPS = "clip_id string, path string, width int, height int, fps double, duration_s double, codec string, rotation int"
FRAMES = "stream_id string, frame_index int, ts timestamp, t double"
CANDIDATES = f"stream_id string, frame_index int, detector int, cand int, x_rel double, y_rel double, w_rel double, h_rel double, keypoints_rel array<{POINT}>, score double, frame_w int, frame_h int"
DETECTIONS = f"stream_id string, frame_index int, box {BOX}, keypoints array<{POINT}>, score double"
MESH = f"stream_id string, frame_index int, points array<{POINT}>"
MOTION = "stream_id string, frame_index int, t double, aperture double, energy double"
SEGMENTS = "stream_id string, sequence int, start_time double, end_time double, reason string"
HYPOTHESES = "clip_id string, text string, score double, decoder double, ctc double, token_ids array<int>"
REFERENCES = "clip_id string, transcript string, source string"
VOCAB = "token_id int, piece string"
JOBS = "stream_id string, sequence int, created_at timestamp, frames int"
CONTROL = "stream_id string, ts timestamp, message string"
CATALOG = "key string, filename string, sha256 string, size_bytes long"
MANIFEST = "file string, source_sample string, motion string, frames int, fps double, transcript string"
