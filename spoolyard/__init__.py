"""spoolyard: durable sharded queues as an operation log that Spark replays."""
