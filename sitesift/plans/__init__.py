"""Plans: crawl planning (C1-C5, U7) and the records -> silver flow."""
