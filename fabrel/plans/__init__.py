"""From a document to DataFrames: order of entities, generation, inspection."""
