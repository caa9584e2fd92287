"""Tables, features, models and named queries."""
