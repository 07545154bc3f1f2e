"""Analytics over ordered relations, large objects, traces and streams, as Spark programs."""
