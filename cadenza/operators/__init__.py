"""DataFrame operators on signals: framing, scaling, coding, filters, quality and loudness."""
