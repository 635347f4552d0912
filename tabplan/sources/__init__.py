"""Tables, CSV import, the catalog of dataset versions, and export."""
