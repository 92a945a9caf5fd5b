"""Analytics for dated panels and text events on Spark."""
