"""Functions on columns."""

from .codec import decode_avro, decode_many, encode_avro, evolve, rabin64, try_decode_avro
from .framing import decode_soe, encode_soe, is_soe, read_versions, soe_fingerprint, soe_payload
from .json import avro_to_json, decode_json, encode_json, json_to_avro

__all__ = ["avro_to_json", "json_to_avro", "decode_avro", "decode_json", "decode_many", "decode_soe", "encode_avro", "encode_json", "encode_soe", "evolve", "is_soe", "rabin64", "read_versions", "soe_fingerprint", "soe_payload", "try_decode_avro"]
