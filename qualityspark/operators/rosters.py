"""Suite rosters."""

from __future__ import annotations

from qualityspark.operators.checks import CheckRef, Suite

# Check id, type and level of the FAIR suite, in suite order.
_FAIR = """
resource.abstractLength.sufficient-2.0.0 Findable REQUIRED
resource.type.valid-2.0.0 Findable INFO
resource.keywords.controlled-2.1.0 Findable OPTIONAL
resource.keywords.present-2.1.0 Findable REQUIRED
resource.keywordType.present-2.1.0 Findable OPTIONAL
resource.publicationDate.timeframe-2.0.0 Findable OPTIONAL
metadata.identifier.present-2.0.0 Findable REQUIRED
resource.creator.present.1 Findable REQUIRED
resource.creatorIdentifier.present-2.0.0 Findable REQUIRED
resource.revisionDate.present.1 Findable OPTIONAL
entity.identifier.present-2.0.0 Findable REQUIRED
entity.identifierType.present-2.0.0 Findable OPTIONAL
resource.publicationDate.present-2.0.0 Findable REQUIRED
resource.titleLength.sufficient.1 Findable REQUIRED
resource.spatialExtent.present.1 Findable OPTIONAL
geographic.description.present.2 Findable OPTIONAL
resource.taxonomicExtent.present.1 Findable OPTIONAL
resource.temporalExtent.present.1 Findable OPTIONAL
resource.accessControlRules.present.1 Accessible REQUIRED
resource.landingPage.present-2.0.0 Accessible REQUIRED
resource.distributionContact.present-2.0.0 Accessible REQUIRED
resource.distributionContactIdentifier.present-2.0.0 Accessible REQUIRED
metadata.identifier.resolvable-2.0.0 Accessible REQUIRED
resource.publisher.present-2.0.0 Accessible REQUIRED
resource.publisherIdentifier.present-2.0.0 Accessible OPTIONAL
resource.serviceLocation.present.1 Accessible OPTIONAL
resource.serviceProvider.present-2.0.0 Accessible OPTIONAL
entity.distributionURL.resolvable-2.0.0 Accessible REQUIRED
entity.attributeName.differs-2.0.0 Interoperable REQUIRED
entity.attributeNames.unique-2.0.0 Interoperable REQUIRED
entity.attributeDefinition.present-2.0.0 Interoperable REQUIRED
entity.attributeDefinition.sufficient-2.0.0 Interoperable REQUIRED
entity.attributeStorageType.present-2.0.0 Interoperable OPTIONAL
entity.checksum.present-2.0.0 Interoperable REQUIRED
entity.attributeCoverageContentType.present-2.0.0 Interoperable OPTIONAL
entity.attributeEnumeratedDomains.present.1 Interoperable REQUIRED
entity.format.present-2.0.0 Interoperable REQUIRED
entity.name.present-2.0.0 Interoperable REQUIRED
entity.type.present.1 Interoperable OPTIONAL
resource.serviceType.present.1 Interoperable OPTIONAL
entity.format.nonproprietary-2.0.1 Reusable REQUIRED
entity.attributeDomain.present-2.0.0 Reusable REQUIRED
entity.attributeUnits.present-2.0.0 Reusable REQUIRED
entity.attributeMeasurementScale.present-2.0.0 Reusable OPTIONAL
entity.attributePrecision.present-2.0.0 Reusable OPTIONAL
entity.description.present-2.0.0 Reusable REQUIRED
entity.qualityDescription.present.1 Reusable REQUIRED
resource.methods.present.1 Reusable REQUIRED
provenance.ProcessStepCode.present-2.0.0 Reusable REQUIRED
provenance.sourceEntity.present.1 Reusable REQUIRED
provenance.trace.present.1 Reusable REQUIRED
resource.license.present-2.0.0 Reusable REQUIRED
"""

FAIR_SUITE = Suite(
    "FAIR-suite-0.4.0",
    tuple(CheckRef(*line.split()) for line in _FAIR.strip().splitlines()),
    "FAIR Recommendation Metadata Suite",
)
