"""Schemas of the library's tables. Times are UTC epoch milliseconds; a null field means the source doesn't supply it."""

from __future__ import annotations

SERIES = ["exchange", "market_type", "symbol"]
BARS = "exchange string, market_type string, symbol string, interval string, open_time bigint, close_time bigint, open double, high double, low double, close double, volume double, quote_volume double, trades bigint, taker_buy_base double, taker_buy_quote double, source string, is_closed boolean"
TRADES = "exchange string, market_type string, symbol string, agg_trade_id bigint, price double, quantity double, trade_time_ms bigint, is_buyer_maker boolean, first_trade_id bigint, last_trade_id bigint"
LEVEL = "struct<price:double,quantity:double>"
BOOKS = f"exchange string, market_type string, symbol string, last_update_id bigint, bids array<{LEVEL}>, asks array<{LEVEL}>, event_time_ms bigint"
DELTAS = f"exchange string, market_type string, symbol string, first_update_id bigint, final_update_id bigint, previous_final_update_id bigint, bids array<{LEVEL}>, asks array<{LEVEL}>, event_time_ms bigint"
EVENTS = "kafka_topic string, kafka_partition int, kafka_offset bigint, event_id string, partition_key string, event_time_ms bigint, sequence_start bigint, sequence_end bigint, envelope_sha256 string, envelope_json string"
